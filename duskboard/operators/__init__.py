"""Table-to-table operators; every function takes and returns a DataFrame and stays lazy."""
