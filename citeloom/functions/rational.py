"""Exact rationals as (numerator, denominator) columns of longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's algorithm, in at most 96 steps (enough for longs)."""
    step = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
    def next_step(s: Column, _: Column) -> Column:
        rest = F.when(s["y"] == 0, F.lit(0)).otherwise(s["x"] % s["y"]).cast("long")
        return F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), rest.alias("y"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(96)), step, next_step)
    return done["x"]


def reduced(numerator: Column, denominator: Column) -> tuple[Column, Column]:
    by = F.greatest(gcd(numerator, denominator), F.lit(1))
    whole = [(x.cast("decimal(38,0)") / by.cast("decimal(38,0)")).cast("long") for x in (numerator, denominator)]
    return whole[0], whole[1]


def text(numerator: Column, denominator: Column) -> Column:
    return F.concat_ws("/", numerator.cast("string"), denominator.cast("string"))
