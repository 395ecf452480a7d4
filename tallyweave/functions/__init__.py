"""Scalar functions as Column expressions; those that need Python are marked so."""
