"""Column expressions: numbers, dates, keyed draws, credit formulas."""
