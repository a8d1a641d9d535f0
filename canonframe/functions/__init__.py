"""Column expressions: addresses, text folding, references, keys, years."""
