"""Header operations: geometry in, geometry out; a few numbers on the driver."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from gridloom.grid import Geometry


def describe(g: Geometry) -> dict:
    return {"origin": g.origin, "spacing": g.spacing, "size": g.size, "direction": g.direction}


def set_spacing(g: Geometry, spacing: tuple[float, ...]) -> Geometry:
    return replace(g, spacing=spacing)


def set_time_spacing(g: Geometry, step: float) -> Geometry:
    return replace(g, spacing=(*g.spacing[:-1], step))


def set_origin(g: Geometry, origin: tuple[float, ...]) -> Geometry:
    return replace(g, origin=origin)


def set_direction(g: Geometry, direction: tuple[tuple[float, ...], ...]) -> Geometry:
    return replace(g, direction=direction)


def reset_direction(g: Geometry) -> Geometry:
    return Geometry(g.size, g.spacing, g.origin)


def copy_header(source: Geometry, target: Geometry, direction: bool = True, origin: bool = True, spacing: bool = True) -> Geometry:
    return Geometry(target.size, source.spacing if spacing else target.spacing, source.origin if origin else target.origin, source.direction if direction else target.direction)


def simplified(g: Geometry) -> Geometry:
    """Directions rounded to whole numbers, origins to two decimals."""
    return Geometry(g.size, g.spacing, tuple(round(o, 2) for o in g.origin), tuple(tuple(float(np.rint(d)) for d in row) for row in g.direction))


def compare(a: Geometry, b: Geometry) -> int:
    """0 for like headers; 1 where an origin's sign differs, 2 where directions differ by 0.7 or more (Frobenius), 3 for both."""
    sign = any(np.sign(p) != np.sign(q) for p, q in zip(a.origin, b.origin, strict=True))
    turn = float(np.linalg.norm(np.subtract(a.direction, b.direction))) >= 0.7
    return int(sign) + 2 * int(turn)


def align_origin(g: Geometry, shift: tuple[float, ...]) -> Geometry:
    return replace(g, origin=tuple(o + s for o, s in zip(g.origin, shift, strict=True)))
