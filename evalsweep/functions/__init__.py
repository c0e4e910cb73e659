"""Column functions: pure expressions, no I/O and no actions."""
