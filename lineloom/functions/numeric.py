"""Numeric scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(x: Column, limit: float = 20.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), x))


def sigmoid(x: Column) -> Column:
    """Logistic function of x clipped to +-20."""
    return 1 / (1 + F.exp(-clipped(x)))


def sigmoid_slope(y: Column) -> Column:
    """Derivative of the logistic function, from its value."""
    return y * (1 - y)


def tanh(x: Column) -> Column:
    return F.tanh(clipped(x))


def tanh_slope(y: Column) -> Column:
    return 1 - y * y


def log_add(x: Column, y: Column) -> Column:
    """log(exp(x) + exp(y)); the greater of the two when they are more than 10 apart."""
    return F.when(F.abs(x - y) > 10, F.greatest(x, y)).otherwise(F.log(F.exp(clipped(x - y)) + 1) + y)


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpack_rgb(v: Column) -> list[Column]:
    return [F.shiftright(v, s).bitwiseAND(255) for s in (16, 8, 0)]


def black_background(label: Column) -> Column:
    """White, the background on disk, to 0."""
    return F.when(label == 0xFFFFFF, 0).otherwise(label)


def white_background(label: Column) -> Column:
    return F.when(label == 0, 0xFFFFFF).otherwise(label)


def column_id(label: Column) -> Column:
    return label.bitwiseAND(0xFF0000)


def paragraph_id(label: Column) -> Column:
    return label.bitwiseAND(0xFFFF00)


def character_cost(p: Column, floor: float = 1e-6) -> Column:
    return -F.log(F.greatest(p, F.lit(floor)))


def norm(vector: Column, p: float = 2.0) -> Column:
    """L_p norm of an array."""
    return F.pow(F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x.cast("double")), F.lit(p))), F.lit(1 / p))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
