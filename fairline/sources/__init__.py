"""Readers, layouts, writers, and the mapping of the star-schema tables onto match tables."""
