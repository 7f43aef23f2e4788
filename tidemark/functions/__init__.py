"""Scalar values, clocks and predicates, as Columns and in Python."""
