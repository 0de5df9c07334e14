"""SQL for DuckDB that computes the same results from the same tables."""

from __future__ import annotations

K = "json_extract_string(props, '$.k')::DOUBLE"


def r(expression: str, digits: int = 6) -> str:
    """Rounded; adding zero turns -0.0 into 0.0."""
    return f"(round({expression}, {digits}) + 0.0)"


def tenth(expression: str) -> str:
    return nearest(expression, 1)


def nearest(expression: str, digits: int) -> str:
    """Decimal nearest to the binary value, exact ties to even."""
    return f"(format('{{:.{digits}f}}', {expression})::DOUBLE + 0.0)"


def nearest_up(expression: str) -> str:
    """Four digits, exact ties (multiples of 1/32) up."""
    return f"""CASE WHEN ({expression}) * 32 = floor(({expression}) * 32)
      THEN floor(({expression}) * 10000 + 0.5) / 10000 ELSE {nearest(expression, 4)} END"""


def four(expression: str) -> str:
    return f"round_even({expression}, 4)"


def clip(expression: str, low: str = "0.0", high: str = "100.0") -> str:
    return f"CASE WHEN {expression} IS NOT NULL THEN least({high}::DOUBLE, greatest({low}::DOUBLE, {expression})) END"


def _events(machine: str) -> str:
    return f"""SELECT event_id, epoch_us(date_trunc('minute', ts)) AS start_time,
      user_id AS collection_id, {machine} AS machine_id,
      value / 100 AS avg_cpu, {K} / 100 AS avg_memory,
      value / 100 * 1.2::DOUBLE AS max_cpu, {K} / 100 * 1.1::DOUBLE AS max_memory,
      CASE WHEN event_id % 7 <> 0 THEN {K} / 200 END AS assigned_memory,
      1 + (event_id % 10) / 10 AS cycles_per_instruction
    FROM events"""


USAGE = {
    "events": _events("event_type"),
    "users": _events("user_id::VARCHAR"),
    "pairs": _events("user_id::VARCHAR || '-' || event_type"),
    "lines": """SELECT epoch_us(l_shipdate) AS start_time, l_orderkey AS collection_id,
      l_suppkey::VARCHAR AS machine_id, l_quantity / 50 AS avg_cpu, l_discount * 10 AS avg_memory
    FROM lineitem""",
}
INTERVAL = {"events": 300, "users": 3600, "pairs": 3600, "lines": 86400}
MAXIMA = {"events": True, "users": True, "pairs": True, "lines": False}

TEXT_TELEMETRY = f"""SELECT CASE WHEN event_id % 13 <> 0 THEN 'm' || (user_id % 40)::VARCHAR END AS machine_id,
      CASE event_id % 10 WHEN 0 THEN 'abc' WHEN 1 THEN ' ' WHEN 2 THEN ' ' || value::VARCHAR || ' '
        ELSE value::VARCHAR END AS cpu_usage,
      json_extract_string(props, '$.k') AS memory_usage,
      CASE WHEN event_id % 7 <> 0 THEN ({K} / 2)::VARCHAR END AS assigned_memory,
      event_id AS row_order
    FROM events"""


def columns(kind: str) -> list[str]:
    """Columns of the rolled-up series, without the job count."""
    if MAXIMA[kind]:
        return ["cpu_usage", "memory_usage", "assigned_memory", "max_cpu_usage", "max_memory_usage"]
    return ["cpu_usage", "memory_usage"]


def cleaned(kind: str) -> str:
    extra = ""
    if MAXIMA[kind]:
        extra = f""", {clip('max_cpu * 100')} AS max_cpu_usage, {clip('max_memory * 100')} AS max_memory_usage,
      assigned_memory, cycles_per_instruction"""
    return f"""usage AS ({USAGE[kind]}),
  cleaned AS (SELECT make_timestamp(start_time) AS timestamp, machine_id, collection_id,
      {clip('avg_cpu * 100')} AS cpu_usage, {clip('avg_memory * 100')} AS memory_usage{extra}
    FROM usage WHERE avg_cpu IS NOT NULL AND avg_memory IS NOT NULL AND machine_id IS NOT NULL)"""


def rolled(kind: str) -> str:
    extra = ""
    if MAXIMA[kind]:
        extra = """, max(max_cpu_usage) AS max_cpu_usage, max(max_memory_usage) AS max_memory_usage,
      coalesce(sum(assigned_memory), 0.0) AS assigned_memory"""
    return f"""{cleaned(kind)},
  summed AS (SELECT timestamp, machine_id, coalesce(sum(cpu_usage), 0.0) AS cpu_usage,
      coalesce(sum(memory_usage), 0.0) AS memory_usage,
      count(DISTINCT collection_id) AS running_jobs_count{extra}
    FROM cleaned WHERE timestamp IS NOT NULL GROUP BY timestamp, machine_id),
  rolled AS (SELECT * REPLACE ({clip('cpu_usage')} AS cpu_usage, {clip('memory_usage')} AS memory_usage)
    FROM summed)"""


def bins(kind: str, keep: list[str] | None = None) -> str:
    means = ", ".join(f"avg({c}) AS {c}" for c in keep or columns(kind))
    return f"""{rolled(kind)},
  bins AS (SELECT machine_id, epoch_us(timestamp) // {INTERVAL[kind] * 1000000} AS bin_no, {means}
    FROM rolled GROUP BY 1, 2)"""


def filled(kind: str) -> str:
    carried = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in columns(kind)
    )
    values = ", ".join(f"b.{c}" for c in columns(kind))
    return f"""{bins(kind)},
  spans AS (SELECT machine_id, min(bin_no) AS lo, max(bin_no) AS hi FROM bins GROUP BY 1),
  spine AS (SELECT machine_id, unnest(generate_series(lo, hi)) AS bin_no FROM spans),
  gridded AS (SELECT s.machine_id, s.bin_no, b.machine_id IS NOT NULL AS occupied, {values}
    FROM spine s LEFT JOIN bins b ON s.machine_id = b.machine_id AND s.bin_no = b.bin_no),
  filled AS (SELECT machine_id, bin_no, max(occupied::INT) OVER w AS reached, {carried} FROM gridded
    WINDOW w AS (PARTITION BY machine_id ORDER BY bin_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


def series(kind: str) -> str:
    """CTEs ending in ``series``, ``windows`` and ``latest``."""
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns(kind))
    micros = INTERVAL[kind] * 1000000
    return f"""WITH {filled(kind)},
  series AS (SELECT *, make_timestamp(bin_no * {micros}) AS bin,
      row_number() OVER (PARTITION BY machine_id ORDER BY bin_no) - 1 AS rn,
      count(*) OVER (PARTITION BY machine_id) AS n
    FROM filled WHERE {complete}),
  marks AS (SELECT *, n - 71 AS nw, floor((n - 71) * 0.7::DOUBLE)::BIGINT AS train_end,
      floor((n - 71) * 0.15::DOUBLE)::BIGINT AS val_count FROM series WHERE n >= 72),
  windows AS (SELECT *, rn - 59 AS window_idx,
      CASE WHEN rn - 59 < train_end THEN 'train' WHEN rn - 59 < train_end + val_count THEN 'val'
        ELSE 'test' END AS split
    FROM marks WHERE rn >= 59 AND rn < n - 12),
  latest AS (SELECT *, (rn - (n - 72))::INT AS step FROM marks WHERE rn >= n - 72 AND rn < n - 12)"""


def scalers(names: list[str], source: str = "marks") -> str:
    """CTE of wide per-machine bounds from the training rows."""
    bounds = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in names)
    return f"""bounds AS (SELECT machine_id, {bounds} FROM {source}
    WHERE rn < floor(n * 0.7::DOUBLE) GROUP BY machine_id)"""


def scaled(column: str, table: str = "") -> str:
    span = f"CASE WHEN {column}_hi = {column}_lo THEN 1.0::DOUBLE ELSE {column}_hi - {column}_lo END"
    return f"(({table}{column} - {column}_lo) / ({span}))"


def predictions(kind: str, widths: tuple[int, ...] = (12,)) -> str:
    """CTEs ending in ``predictions``: truth and moving average of every window."""
    means = ", ".join(
        f"avg({c}) OVER (PARTITION BY machine_id ORDER BY rn ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {c}_mean{w}"
        for w in widths
        for c in ("cpu", "memory")
    )
    parts = " UNION ALL ".join(
        f"""SELECT machine_id, rn - 59 AS window_idx, split, 'moving_avg_{w}' AS model,
        unnest(generate_series(1, 12))::INT AS step, '{c}_usage' AS target, unnest({c}_ahead) AS y_true,
        {c}_mean{w} AS y_pred FROM framed WHERE rn >= 59 AND rn < n - 12"""
        for w in widths
        for c in ("cpu", "memory")
    )
    return f"""{series(kind)}, {scalers(['cpu_usage', 'memory_usage'])},
  scaled AS (SELECT m.machine_id, rn, n, {scaled('cpu_usage')} AS cpu, {scaled('memory_usage')} AS memory,
      CASE WHEN rn - 59 < train_end THEN 'train' WHEN rn - 59 < train_end + val_count THEN 'val' ELSE 'test' END AS split
    FROM marks m JOIN bounds b ON m.machine_id = b.machine_id),
  framed AS MATERIALIZED (SELECT *, {means}, list(cpu) OVER y AS cpu_ahead, list(memory) OVER y AS memory_ahead
    FROM scaled WINDOW y AS (PARTITION BY machine_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)),
  predictions AS ({parts})"""


def errors(keys: str, source: str = "predictions", where: str = "") -> str:
    """CTE of error sums by key."""
    return f"""sums AS (SELECT {keys}, count(*) AS c, sum(abs(y_true - y_pred)) AS a,
      sum((y_true - y_pred) * (y_true - y_pred)) AS s,
      sum(abs(y_true - y_pred) / greatest(abs(y_true), 1e-8::DOUBLE)) AS q,
      count(*) FILTER (y_true > 0.8::DOUBLE AND y_pred > 0.8::DOUBLE) AS tp,
      count(*) FILTER (y_true <= 0.8::DOUBLE AND y_pred > 0.8::DOUBLE) AS fp,
      count(*) FILTER (y_true > 0.8::DOUBLE AND y_pred <= 0.8::DOUBLE) AS fn,
      count(*) FILTER (y_true <= 0.8::DOUBLE AND y_pred <= 0.8::DOUBLE) AS tn
    FROM {source} {where} GROUP BY {keys})"""
