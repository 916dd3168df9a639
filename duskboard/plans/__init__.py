"""Registered queries: each joins an operator to the given tables and to its SQL check."""
