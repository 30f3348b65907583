"""Composite plans built from operators."""
