"""Checks over decoded archives, and what follows from their failures."""
