"""Compact forms the estimate works on.

``length_cells``: one row per haul x length, the three sexes side by side. ``haul_cells``:
one row per haul, however often the catch table repeats it. Both are built with partial
aggregation only, so a haul or stratum holding a third of all rows stays spread out:
the windows below run over one haul's lengths, never over a stratum's hauls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulcomp.functions.rules import KH, SEX_CODE, SEXES, K, rdiv

# Unmeasured hauls of one stratum that share a join key when the stratum's composition is given to them.
HAULS_PER_SLICE = 10_000


def since(df: DataFrame, yrs: int | None) -> DataFrame:
    return df.filter(F.col("year") >= (yrs or 0))


def length_grid(lfreq: DataFrame, yrs: int | None = 2017, by_stratum: bool = False) -> DataFrame:
    """Per species: every length of any year x every year from ``yrs`` [x every stratum].

    One scan and one small shuffle: the sets hold distinct lengths, years and strata only.
    """
    sets = lfreq.groupBy("species_code").agg(
        F.collect_set("length").alias("lengths"),
        F.collect_set("year").alias("years"),
        *([F.collect_set("stratum").alias("strata")] if by_stratum else []),
    )
    grid = sets.withColumn("year", F.explode(F.filter("years", lambda y: y >= F.lit(yrs or 0))))
    if by_stratum:
        grid = grid.withColumn("stratum", F.explode("strata"))
    grid = grid.withColumn("length", F.explode("lengths"))
    return grid.select("year", "species_code", *(["stratum"] if by_stratum else []), "length")


def length_cells(lfreq: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fish by haul x length: males, females, unsexed (NULL = no such row).

    Adds per haul ``tot`` (all fish, NULL if any frequency is), ``sexed``, and ``first``,
    1 on one row of each haul so that hauls can be counted by a sum.
    """
    fish = F.coalesce(F.col("frequency"), F.lit(0)).cast("bigint")
    counts = lfreq.groupBy(*by, *KH, "length").agg(
        *[F.sum(F.when(F.col("sex") == SEX_CODE[s], fish)).alias(s) for s in SEXES],
        F.count_if(F.col("frequency").isNull()).alias("missing"),
    )
    haul = Window.partitionBy(*by, *KH)
    m, f, u = [F.coalesce(F.col(s), F.lit(0)) for s in SEXES]
    # Without replicates, by haul alone: what follows meets other tables by haul.
    placed = counts if by else counts.repartition(*KH)
    return (
        placed.withColumn("first", F.when(F.row_number().over(haul.orderBy("length")) == 1, 1).otherwise(0))
        .withColumn("tot", F.when(F.sum("missing").over(haul) == 0, F.sum(m + f + u).over(haul)))
        .withColumn("sexed", F.sum(m + f).over(haul))
        .drop("missing")
    )


def haul_cells(cpue: DataFrame) -> DataFrame:
    """Abundance by haul: one row per distinct area (``pos``), with the number of catch rows behind it.

    ``copies`` rows of the catch table have this haul and area, ``catches`` of the haul's rows
    have a catch.
    """
    rows = cpue.groupBy(*KH, "area").agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum("numcpue").alias("num"),
        F.count("numcpue").alias("known"),
        F.count("catchjoin").alias("caught"),
    )
    stratum = rows.groupBy(*K).agg(
        F.when(F.sum("known") == F.sum("copies"), F.sum("num")).alias("k_tot"),
        F.sum("copies").alias("k_rows"),
    )
    haul = Window.partitionBy(*KH)
    n = F.sum("copies").over(haul)
    hauls = (
        rows.withColumn("pos", F.row_number().over(haul.orderBy("area")) - 1)
        .withColumn("h_mean", F.when(F.sum("known").over(haul) == n, F.try_divide(F.sum("num").over(haul), n)))
        .withColumn("catches", F.sum("caught").over(haul))
    )
    stratum_number = F.try_divide(F.col("k_tot"), F.col("k_rows")) * F.col("area")
    return hauls.join(stratum, K).select(
        *KH,
        "pos",
        (rdiv(F.col("h_mean"), F.col("k_tot")) * stratum_number).alias("abund"),
        "copies",
        "catches",
    )


def measured_hauls(lfreq: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return lfreq.select(*by, "hauljoin").distinct()


def hauls_without_lengths(catches: DataFrame, measured: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Catch rows (or haul cells) with a catch whose haul, whatever the species, was not measured."""
    has_catch = F.col("catches") > 0 if "catches" in catches.columns else F.col("catchjoin").isNotNull()
    return catches.filter(has_catch).join(measured, [*by, "hauljoin"], "left_anti")


def fill_grid(grid: DataFrame, wide: DataFrame) -> DataFrame:
    """The grid's rows with their counts, 0 where there are none."""
    return grid.join(wide, grid.columns, "left").fillna(0.0, subset=SEXES).select(*grid.columns, *SEXES)
