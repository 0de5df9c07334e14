"""Bins and forecasts kept up to date from streams of usage rows."""
