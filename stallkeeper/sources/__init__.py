"""Readers, contracts and the commerce data model."""
