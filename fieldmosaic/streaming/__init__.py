"""Structured Streaming forms of the daily workflows."""
