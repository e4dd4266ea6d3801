"""The registered queries on the given tables, with their DuckDB counterparts."""
