"""Relational operators over the compiled text store."""
