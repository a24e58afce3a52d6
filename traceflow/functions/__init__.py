"""Column expressions and the few pandas UDFs."""
