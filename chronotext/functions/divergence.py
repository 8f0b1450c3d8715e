"""Divergences between discrete distributions held as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _cells(p: Column, q: Column, combine) -> Column:
    """Combine two arrays cell by cell, up to the end of the shorter one."""
    length = F.least(F.size(p), F.size(q))
    return F.zip_with(F.slice(p, F.lit(1), length), F.slice(q, F.lit(1), length), combine)


def _total(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda total, cell: total + cell)


def pairwise_mean(p: Column | str, q: Column | str) -> Column:
    return _cells(_column(p), _column(q), lambda a, b: (a + b) / 2)


def _information(a: Column, b: Column) -> Column:
    """a ln(a/b); nothing for a = 0, infinite where b is 0 and a is not."""
    return (
        F.when(a == 0, F.lit(0.0))
        .when(b == 0, F.lit(float("inf")))
        .otherwise(a * F.ln(a / b))
    )


def kl(p: Column | str, q: Column | str) -> Column:
    """Kullback-Leibler divergence in nats."""
    return _total(_cells(_column(p), _column(q), _information))


def js(p: Column | str, q: Column | str) -> Column:
    """Jensen-Shannon divergence in nats, between 0 and ln 2."""

    def both_sides(a: Column, b: Column) -> Column:
        middle = (a + b) / 2
        return _information(a, middle) / 2 + _information(b, middle) / 2

    return _total(_cells(_column(p), _column(q), both_sides))


def normalize(weights: Column | str) -> Column:
    """Weights divided by their sum, which is added up once per array."""
    weights = _column(weights)
    return F.aggregate(
        weights,
        F.lit(0.0),
        lambda total, cell: total + cell,
        lambda total: F.transform(weights, lambda cell: F.try_divide(cell, total)),
    )


def rescale(x: Column | str, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """Map [low, high] linearly onto [to_low, to_high]; NULL where low equals high."""
    share = F.try_divide(_column(x) - low, high - low)
    return share * F.lit(to_high - to_low) + F.lit(to_low)
