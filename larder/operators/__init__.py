"""Relational operators of the label domain."""
