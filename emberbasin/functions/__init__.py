"""Column expressions and filter documents."""
