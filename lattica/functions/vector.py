"""Column expressions over vectors, kernels, decays and grid positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sq_dist(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def euclid(a, b) -> Column:
    """Euclidean distance over all components."""
    return F.sqrt(sq_dist(a, b))


def weighted(f_dist: Column, g_dist: Column, w: float) -> Column:
    return (1 - w) * f_dist + w * g_dist


def augmented(f, g, a: float) -> Column:
    """One vector whose Euclidean distance is sqrt(sum f^2 + sum (a g)^2)."""
    return F.concat(_c(f), F.transform(_c(g), lambda v: v * a))


def dims(x, first: int, last: int) -> Column:
    """Components ``first``..``last`` (from 1) as doubles."""
    return F.slice(_c(x).cast("array<double>"), first, last - first + 1)


# ---- kernels: distance, width

def gauss(dist, width) -> Column:
    q = _c(dist) / F.greatest(_c(width), F.lit(1e-127))
    return F.exp(-0.5 * q * q)


def bubble(dist, width) -> Column:
    return F.when(_c(dist) <= _c(width), 1.0).otherwise(0.0)


def linear_kernel(dist, slope) -> Column:
    return F.greatest(1 - _c(dist) * _c(slope), F.lit(0.0))


# ---- decays: progress in 0..1

def linear_decay(x, start: float, end: float) -> Column:
    return (end - start) * _c(x) + start


def power_decay(x, start: float, end: float) -> Column:
    return start * F.pow(F.lit(end / start), _c(x))


def exponential_decay(x, start: float, end: float, eta: float = -1.0, span: float = 1.0) -> Column:
    """Offset exponential from ``start`` to ``end``; eta <= 0 derives it. Undefined at eta = 1/2."""
    from math import log, sqrt

    eta = eta if eta > 0 else sqrt(end) / (sqrt(start) + sqrt(end))
    off = (eta * eta * (start - end) - end + 2 * eta * end) / (2 * eta - 1)
    rate = log((start - off) / (end - off)) / span
    return off + F.exp(log(start - off) - rate * _c(x))


def sigmoid_decay(x, scale: float) -> Column:
    return 1 / (1 + F.exp(-_c(x) * scale + scale / 2))


# ---- hop distances on grids

def rect_dist(x0, y0, x1, y1) -> Column:
    return F.abs(_c(x0) - _c(x1)) + F.abs(_c(y0) - _c(y1))


def _wrap(a, b, n: int) -> Column:
    d = F.abs(_c(a) - _c(b))
    return F.least(d, n - d)


def toroid_dist(x0, y0, x1, y1, nx: int, ny: int) -> Column:
    return _wrap(x0, x1, nx) + _wrap(y0, y1, ny)


def hex_dist(x0, y0, x1, y1) -> Column:
    """Hexagons in columns; odd columns lie half a cell lower."""
    x0, y0, x1, y1 = map(_c, (x0, y0, x1, y1))
    return _hex(x0, F.abs(x0 - x1), F.abs(y0 - y1), y1 > y0)


def _hex(x0, dx, dy, up) -> Column:
    even = F.pmod(x0, F.lit(2)) == 0
    half = F.when(up == even, F.floor(dx / 2)).otherwise(F.ceil(dx / 2))
    return (dx + dy - F.least(dy, half)).cast("int")


def hex_toroid_dist(x0, y0, x1, y1, nx: int, ny: int) -> Column:
    """The least over both ways round in each direction; ``nx`` must be even."""
    if nx % 2:
        raise ValueError("a hexagonal toroid needs an even number of columns")
    x0, y0, x1, y1 = map(_c, (x0, y0, x1, y1))
    dx, dy, up = F.abs(x0 - x1), F.abs(y0 - y1), y1 > y0
    return F.least(*(_hex(x0, a, b, u) for a in (dx, nx - dx) for b, u in ((dy, up), (ny - dy, ~up))))
