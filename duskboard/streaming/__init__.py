"""Incremental form of the write path."""
