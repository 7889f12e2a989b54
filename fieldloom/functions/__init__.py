"""Column expressions that carry the panel semantics."""
