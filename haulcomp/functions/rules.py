"""Arithmetic and missing-value rules shared by every operator.

Missing is always NULL: no helper here ever produces NaN. Aggregates that must be
missing as soon as one input is missing use ``strict_sum`` / ``strict_avg``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

# Key columns, sex codes and replicate labels of the data model.
K = ["year", "species_code", "stratum"]
KH = [*K, "hauljoin"]
SEXES = ["males", "females", "unsexed"]
SEX_CODE = {"males": 1, "females": 2, "unsexed": 3}
REPLICATE = ["type", "run", "ss", "sim"]

INF = float("inf")
SQRT_2PI = math.sqrt(2 * math.pi)


def rdiv(a: Column, b: Column) -> Column:
    """a / b where 0/0 is NULL, x/0 is a signed infinity, and NULL in gives NULL out."""
    at_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def strict_sum(x: Column, over: WindowSpec | None = None) -> Column:
    """Sum that is NULL if any input is NULL; over a window if one is given."""
    return _strict(F.sum, x, over)


def strict_avg(x: Column, over: WindowSpec | None = None) -> Column:
    """Mean that is NULL if any input is NULL; over a window if one is given."""
    return _strict(F.avg, x, over)


def _strict(agg, x: Column, over: WindowSpec | None) -> Column:
    total, seen, rows = agg(x), F.count(x), F.count(F.lit(1))
    if over is not None:
        total, seen, rows = total.over(over), seen.over(over), rows.over(over)
    return F.when(seen == rows, total)


def sum0(x: Column) -> Column:
    """Sum skipping NULL; 0 when nothing is left."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def half_even(x: Column) -> Column:
    """Round half to even; what is within 1e-12 of its size from a half is a half, so ties do not hang on summation order."""
    halves = F.rint(x * 2)
    return F.when(F.abs(x * 2 - halves) <= F.abs(x) * 1e-12, F.rint(halves / 2)).otherwise(F.rint(x))


def required(name: str) -> Column:
    """The column; a missing value stops the job, since dropping the row would change every total."""
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is missing"))).otherwise(F.col(name))


def replicate_keys(df: DataFrame) -> list[str]:
    """The replicate labels a frame carries, in canonical order."""
    return [c for c in REPLICATE if c in df.columns]


def explode_to(df: DataFrame, size: Column, name: str, chunk: int = 8192) -> DataFrame:
    """Repeat each row ``size`` times, numbered 1..size in ``name``; rows with size < 1 vanish.

    Two generators in a row keep every array within ``chunk`` elements (or size / chunk).
    """
    return (
        df.withColumn("_size", size.cast("bigint"))
        .filter(F.col("_size") > 0)
        .withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_size - 1) div {chunk})")))
        .withColumn("_step", F.explode(F.expr(f"sequence(1L, least({chunk}L, _size - _chunk * {chunk}))")))
        .withColumn(name, F.col("_chunk") * chunk + F.col("_step"))
        .drop("_size", "_chunk", "_step")
    )


def explode_spread(df: DataFrame, size: Column, name: str, chunk: int = 16_384) -> DataFrame:
    """``explode_to`` where one row may stand for a large part of all: rows are cut into parts, and the parts spread."""
    keys = df.columns
    parts = df.withColumn("_size", size.cast("bigint")).filter(F.col("_size") > 0)
    parts = parts.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_size - 1) div {chunk})"))).repartition(*keys, "_part")
    in_part = F.least(F.lit(chunk), F.col("_size") - F.col("_part") * chunk)
    rows = explode_to(parts.withColumn("_take", in_part), F.col("_take"), "_of_part", chunk)
    return rows.select(*keys, (F.col("_part") * chunk + F.col("_of_part")).alias(name))


def require_strata(by_stratum: bool, *frames: DataFrame) -> None:
    """Refuse stratified input unless the caller asked for strata, and the reverse."""
    for df in frames:
        if ("stratum" in df.columns) != by_stratum:
            raise ValueError("by_stratum must say whether the inputs have a stratum column")
