"""Column functions of archives."""
