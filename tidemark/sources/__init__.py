"""Readers and writers."""
from tidemark.sources.tables import load, TABLES  # noqa: F401
