"""End-to-end plans, the query registry and the DuckDB oracle SQL."""
