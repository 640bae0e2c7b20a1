"""Audit, copy and repair checkpointed ledger archives with Spark DataFrames."""

__version__ = "0.1.0"
