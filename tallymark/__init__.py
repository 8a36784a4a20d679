"""Ledger matching as Spark jobs."""
