"""Column functions: text, diff, reply parsing and vector expressions."""
