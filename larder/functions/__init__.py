"""Scalar expressions with the label domain's number and text semantics."""
