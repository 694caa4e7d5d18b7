"""Column functions: text, counts, dates, masking and identifiers."""
