"""Operators for the preparation of training text; nothing outside this package imports it."""
