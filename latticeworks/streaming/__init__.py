"""Grids that grow from streams."""
