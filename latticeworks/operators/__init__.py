"""Operators on voxel grids; each takes and returns immutable values."""
