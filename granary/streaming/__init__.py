"""Continuous versions of the event operators."""
