"""Column expressions: hashing and sketches."""
