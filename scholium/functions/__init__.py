"""Column functions: text normalisers, year ranges, formulas."""
