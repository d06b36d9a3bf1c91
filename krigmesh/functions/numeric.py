"""Column expressions of numbers, names and variogram models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def to_number(name: str) -> Column:
    """Text to double; what is no number becomes null."""
    return F.expr(f"try_cast(trim(`{name}`) AS DOUBLE)")


def clamp(c: Column, low: Column, high: Column) -> Column:
    """c inside [low, high]; null stays null (least and greatest would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, high), low))


def clean_name(c: Column, keep_dash: bool = True, empty: str = "run") -> Column:
    """A name fit for files: runs of other characters become one underscore, none at the ends."""
    body = F.regexp_replace(c, r"[^A-Za-z0-9_-]+" if keep_dash else r"[^A-Za-z0-9_]+", "_")
    body = F.regexp_replace(F.regexp_replace(body, "_+", "_"), "^_|_$", "")
    return F.when(body == "", F.lit(empty)).otherwise(body)


def practical_range(model: Column, range_: Column) -> Column:
    """Distance at which a model has nearly reached its sill."""
    return F.when(model == "Exp", 3 * range_).when(model == "Gau", F.sqrt(F.lit(3.0)) * range_).otherwise(range_)


def model_shape(model: Column, h: Column, range_: Column) -> Column:
    """Structured part of a variogram model at distance h, from 0 to 1."""
    x = h / range_
    sph = F.when(h >= range_, F.lit(1.0)).otherwise(1.5 * x - 0.5 * x * x * x)
    return F.when(model == "Sph", sph).when(model == "Gau", 1 - F.exp(-(x * x))).otherwise(1 - F.exp(-x))


def model_gamma(model: Column, nugget: Column, psill: Column, range_: Column, h: Column) -> Column:
    """Variogram value at h; 0 at h = 0."""
    return F.when(h == 0, F.lit(0.0)).otherwise(nugget + psill * model_shape(model, h, range_))


def round_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def flags(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in named]))
