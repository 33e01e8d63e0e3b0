"""Length arguments: whole numbers count cells, reals are world units."""

from __future__ import annotations

import math


def in_cells(x: int | float, size: float) -> int:
    return x if isinstance(x, int) else math.ceil(x / size)


def in_world(x: int | float, size: float) -> float:
    return float(x) if isinstance(x, float) else x * size
