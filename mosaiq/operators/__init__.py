"""Operators on signals in long form: one row for each sample, integer coordinates, a value."""
