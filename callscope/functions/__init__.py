"""Column expressions: no joins, no aggregates, no Python UDFs."""
