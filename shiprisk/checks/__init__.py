"""Independent DuckDB oracle SQL and a result comparer for tests."""
