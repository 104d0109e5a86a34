"""Readers, writers and fixed schemas."""
