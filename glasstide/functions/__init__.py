"""Column expressions and the recursive-mean helper."""
