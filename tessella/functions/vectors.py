"""Vector and shading functions as Column expressions; a vector is a triple of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str, names: str = "xyz") -> Vec:
    return tuple(F.col(prefix + n) for n in names)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return length(sub(a, b))


def normalize(a: Vec) -> Vec:
    """Unit vector; null for a vector of no length."""
    n = length(a)
    return tuple(F.when(n > 0, x / n) for x in a)


def sqr(x: Column) -> Column:
    return x * x


def cube(x: Column) -> Column:
    return x * x * x


def fract(x: Column) -> Column:
    return x - F.floor(x)


def clamp(x: Column, low, high) -> Column:
    """NaN gives the lower bound."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(F.isnan(x) | (x < low), low).when(x > high, high).otherwise(x)


def mix(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


def step(edge, x: Column) -> Column:
    return F.when(x < edge, 0.0).otherwise(1.0)


def smoothstep(a: float, b: float, x: Column) -> Column:
    t = clamp((x - a) / (b - a), 0, 1)
    return t * t * (3 - 2 * t)


def sgn(x: Column) -> Column:
    """-1 below zero, else 1."""
    return F.when(x < 0, -1).otherwise(1)


# Colours by name, as red, green and blue from 0 to 1.
COLOURS = {
    "black": (0.0, 0.0, 0.0), "white": (1.0, 1.0, 1.0), "red": (1.0, 0.0, 0.0), "green": (0.0, 1.0, 0.0), "blue": (0.0, 0.0, 1.0),
    "yellow": (1.0, 1.0, 0.0), "cyan": (0.0, 1.0, 1.0), "magenta": (1.0, 0.0, 1.0),
}


def colour(name: str) -> Vec:
    return tuple(F.lit(x) for x in COLOURS[name])


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Vec:
    """Hue in radians, taken modulo a full turn."""
    turn = F.lit(h) - F.floor(F.lit(h) / (2 * math.pi)) * (2 * math.pi)
    six = turn * 3 / math.pi
    i = F.floor(six).cast("int") % 6
    f = six - F.floor(six)
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))

    def channel(*by_sixth: Column) -> Column:
        out = by_sixth[5]
        for k in range(4, -1, -1):
            out = F.when(i == k, by_sixth[k]).otherwise(out)
        return out

    return channel(v, q, p, p, t, v), channel(t, v, v, q, p, p), channel(p, p, t, v, v, q)
