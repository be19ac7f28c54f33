"""Column expressions: text, dates, rendering, answer parsing, statistics."""
