"""Readers and writers: raw CSV, typed CSV, snapshot tables, test bed."""
