"""Column expressions and the ordering primitives every operator builds on."""
