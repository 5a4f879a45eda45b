"""Incremental refresh of silver and gold as raw files arrive."""
