"""Column expressions: money arithmetic, classifications, display formats."""
