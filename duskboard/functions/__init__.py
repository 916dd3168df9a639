"""Column-to-column functions built from native expressions only."""
