"""Binding of operators to query names and parameters."""
