"""Column expressions: money, dates, text structure, names and answers."""
