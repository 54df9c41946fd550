"""Operators for large text and vector collections; nothing else in the library imports them."""
