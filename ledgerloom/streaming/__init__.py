"""Following archives as they grow."""
