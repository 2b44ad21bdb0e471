"""Operators for text and code collections; nothing outside this package imports it."""
