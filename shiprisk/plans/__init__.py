"""Composite business queries, gold tables and model jobs."""
