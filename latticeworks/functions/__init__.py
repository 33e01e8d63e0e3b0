"""Scalar, vector and polygon functions."""
