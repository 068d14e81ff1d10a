"""Column helpers: missing-value arithmetic and seeded draw keys."""
