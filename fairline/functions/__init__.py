"""Column to Column functions: no shuffles, no Python in the row path."""
