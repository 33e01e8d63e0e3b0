"""Operators for large training-data corpora, each usable on its own DataFrame.

Nothing outside this subpackage imports it.
"""
