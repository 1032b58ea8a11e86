"""Column expressions: text, hashes, vectors and layout arithmetic."""
