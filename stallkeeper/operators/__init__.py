"""Operators: functions from the commerce model (or derived layers) to a DataFrame."""
