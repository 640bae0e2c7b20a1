"""Whole operations, and the table queries."""
