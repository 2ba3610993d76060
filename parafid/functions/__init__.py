"""Column -> Column building blocks (no shuffles, no Python workers)."""
