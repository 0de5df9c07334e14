"""Texts of warnings and errors."""

# Texts users see, with printf places for what they name.
MISSING_COLUMNS = "Missing required column(s): %s. Need at least %s."
EXTRA_FEATURES = "Model expects %d features; ignoring extras: %s."
PADDED_COLUMN = "Column '%s' missing; filled with 0."
NO_MACHINE_COLUMN = "No 'machine_id' column; treating all rows as one machine."
NOT_ENOUGH_ROWS = "Not enough rows: %d available, %d required for a forecast."
CONSTANT_COLUMNS = (
    "One or more feature columns had constant values; forecast may be degenerate."
)
TARGETS_NOT_FEATURES = (
    "Target columns not present in resolved features; forecast is returned in "
    "normalized [0,1] space."
)
NO_SCALER = "No scaler for machine '%s'; returning normalized values."
TOO_SHORT = "Data length (%d) < required (%d)."
MODEL_NOT_FOUND = "Model %r not found or not invokable."
MACHINE_NOT_FOUND = "Machine %r not found."
