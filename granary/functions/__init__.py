"""Scalar functions on Columns."""
