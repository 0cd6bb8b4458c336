"""Column functions: keyed hashes, dates and text."""
