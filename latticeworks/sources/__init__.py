"""Readers of building models and tables, and writers of results."""
