"""Scalar functions and decision tables as Column expressions."""
