"""Inputs and outputs: entity tables, page tables, JSON feeds, partitioned sinks."""
