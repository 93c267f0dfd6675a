"""Column expressions: text, codes, values and filter conditions."""
