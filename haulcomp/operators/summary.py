"""Summaries of replicates, comparisons with the base, and the frames behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcomp.functions.rules import INF, SEXES, rdiv, replicate_keys, require_strata, strict_avg
from haulcomp.operators.distribution import density, density_of, quantiles_of, rank_index

Z = 1.96


def sexes_long(df: DataFrame) -> DataFrame:
    """males / females / unsexed to rows of name and value."""
    ids = [c for c in df.columns if c not in SEXES]
    return df.unpivot(ids, SEXES, "name", "value")


def only(df: DataFrame, species: Sequence | None = None, yrs: Sequence[int] | None = None) -> DataFrame:
    """Rows of the given species and years; None means all. Species may be given as text."""
    if species is not None:
        df = df.filter(F.col("species_code").isin([int(s) for s in species]))
    if yrs is not None:
        df = df.filter(F.col("year").isin([int(y) for y in yrs]))
    return df


def sweep_labels(df: DataFrame) -> list[str]:
    """The labels of a sweep's runs: replicate keys other than the replicate itself."""
    return [c for c in replicate_keys(df) if c != "sim"]


def bin_summary(
    df: DataFrame,
    id: str,
    by_stratum: bool = False,
    species: Sequence | None = None,
    yrs: Sequence[int] | None = None,
) -> DataFrame:
    """Mean over replicates with its standard error and 95% interval, by year, species, sex name and length.

    A sweep's labels (type, run, ss) are kept: each of its runs has its own summary.
    """
    keys = [*sweep_labels(df), "year", "species_code", *(["stratum"] if by_stratum else []), "name", "length"]
    long = sexes_long(only(df, species, yrs))
    se = F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))
    stats = long.groupBy(*keys).agg(
        strict_avg(F.col("value")).alias("mean"),
        F.when(F.count("value") == F.count(F.lit(1)), se).alias("se"),
    )
    return stats.withColumns(
        {"lci": F.col("mean") - F.col("se") * Z, "uci": F.col("mean") + F.col("se") * Z, "id": F.lit(id)}
    )


def compare(
    base: DataFrame,
    sim: DataFrame,
    by_stratum: bool = False,
    base_label: str = "base",
    sim_label: str = "sim",
    species: Sequence | None = None,
    yrs: Sequence[int] | None = None,
) -> DataFrame:
    """Mean over lengths of base and simulation side by side, their difference and percent difference."""
    require_strata(by_stratum, base, sim)
    if base_label == sim_label:
        raise ValueError("the two labels must differ")
    keys = ["year", "species_code", *(["stratum"] if by_stratum else []), "name"]

    def means(df: DataFrame, label: str) -> DataFrame:
        bins = bin_summary(df, label, by_stratum, species, yrs)
        whole = F.count("mean") == F.count(F.lit(1))
        by = [*sweep_labels(df), *keys]
        return bins.groupBy(*by).agg(F.when(whole, F.avg("mean")).alias(label))

    # One row per run of a sweep; without labels the two sides may each have keys of their own.
    left, right = means(sim, sim_label), means(base, base_label)
    table = left.join(right, keys, "left" if sweep_labels(sim) else "full")
    table = table.select(*sweep_labels(sim), *keys, base_label, sim_label)
    b, s = F.col(base_label), F.col(sim_label)
    return table.withColumns({"diff": b - s, "pd": rdiv(b - s, (b + s) / 2) * 100})


def ribbon_frame(
    base: DataFrame,
    sim: DataFrame,
    base_label: str = "base",
    sim_label: str = "sim",
    species: Sequence | None = None,
    yrs: Sequence[int] | None = None,
) -> DataFrame:
    """Lines with 95% ribbons of base and simulation, by sex and year."""
    require_strata(False, base, sim)
    return bin_summary(base, base_label, False, species, yrs).unionByName(
        bin_summary(sim, sim_label, False, species, yrs), allowMissingColumns=True
    )


def density_frame(
    base: DataFrame,
    sim: DataFrame,
    by_stratum: bool = False,
    base_label: str = "base",
    sim_label: str = "sim",
    species: Sequence | None = None,
    yrs: Sequence[int] | None = None,
    points: int = 512,
) -> DataFrame:
    """Density of the compared means (in thousands) by data set, within species x sex."""
    table = compare(base, sim, by_stratum, base_label, sim_label, species, yrs)
    by = [*sweep_labels(sim), "species_code", "name"]
    long = table.unpivot(by, [base_label, sim_label], "data", "value")
    scaled = long.withColumn("value", F.col("value") / 1000)
    return density(scaled, [*by, "data"], "value", points, by)


def diff_density(table: DataFrame, points: int = 512) -> DataFrame:
    """Density of the differences of a stratified comparison, by stratum."""
    return density(table, ["stratum"], "diff", points, [])


def _inverse(ess: DataFrame, species: Sequence | None) -> DataFrame:
    kept = only(ess.filter(F.col("ess") != "ess_t"), species)
    x = rdiv(F.lit(1.0), F.col("value"))
    return kept.withColumn("x", x).filter(F.col("x").isNotNull() & (F.abs("x") != INF))


def box_frame(
    ess: DataFrame, species: Sequence | None = None, keys: Sequence[str] = ("species_code", "ess", "type")
) -> DataFrame:
    """Box statistics of 1 / ess: quartiles, and whiskers at the last value within 1.5 IQR."""
    ranks = rank_index(_inverse(ess, species), keys, "x")
    boxes = quantiles_of(ranks, keys, "x", {"lower": 0.25, "middle": 0.5, "upper": 0.75})
    fence = 1.5 * (F.col("upper") - F.col("lower"))
    x = F.col("x")
    inside = (x >= F.col("lower") - fence) & (x <= F.col("upper") + fence)
    whiskers = ranks.drop("n").join(boxes, list(keys)).groupBy(*keys).agg(
        F.min(F.when(inside, x)).alias("ymin"),
        F.max(F.when(inside, x)).alias("ymax"),
        F.sum(F.when(inside, 0).otherwise(F.col("copies"))).alias("outliers"),
    )
    return boxes.join(whiskers, list(keys)).select(*keys, "n", "ymin", "lower", "middle", "upper", "ymax", "outliers")


def box_outliers(
    ess: DataFrame, species: Sequence | None = None, keys: Sequence[str] = ("species_code", "ess", "type")
) -> DataFrame:
    """The values of 1 / ess beyond the whiskers."""
    values = _inverse(ess, species)
    box = quantiles_of(rank_index(values, keys, "x"), keys, "x", {"lower": 0.25, "upper": 0.75}).drop("n")
    fence = 1.5 * (F.col("upper") - F.col("lower"))
    beyond = (F.col("x") < F.col("lower") - fence) | (F.col("x") > F.col("upper") + fence)
    return values.join(box, list(keys)).filter(beyond).drop("lower", "upper")


def violin_frame(
    ess: DataFrame,
    species: Sequence | None = None,
    keys: Sequence[str] = ("species_code", "ess", "type"),
    points: int = 512,
) -> DataFrame:
    """Density of 1 / ess over each group's range, with its median."""
    ranks = rank_index(_inverse(ess, species).withColumnRenamed("x", "_v"), keys, "_v")
    median = quantiles_of(ranks, keys, "_v", {"median": 0.5}).drop("n")
    curve = density_of(ranks, keys, "_v", points)
    return curve.join(median, list(keys))


def point_range(
    ess: DataFrame,
    species: Sequence | None = None,
    keys: Sequence[str] = ("species_code", "ess", "type", "ss"),
) -> DataFrame:
    """Inverse of the mean ess with a 95% interval whose lower end stops at 0."""
    kept = only(ess.filter(F.col("ess") != "ess_t"), species)
    stats = kept.groupBy(*keys).agg(
        strict_avg(F.col("value")).alias("_avg"),
        F.when(
            (F.count("value") == F.count(F.lit(1))) & (F.max(F.abs("value")) != INF), F.stddev_samp("value")
        ).alias("_sd"),
        F.count(F.lit(1)).alias("_n"),
    )
    mean = rdiv(F.lit(1.0), F.col("_avg"))
    se = rdiv(F.lit(1.0), F.col("_sd")) / F.sqrt("_n")
    out = stats.select(*keys, mean.alias("mean"), se.alias("se"))
    lci, uci = F.col("mean") - F.col("se") * Z, F.col("mean") + F.col("se") * Z
    lci = F.when(~F.isnan(lci), F.when(lci < 0, F.lit(0.0)).otherwise(lci))
    return out.withColumns({"lci": lci, "uci": uci})


def point_range_by_year(
    ess: DataFrame,
    species: Sequence | None = None,
    keys: Sequence[str] = ("year", "species_code", "ess", "type"),
) -> DataFrame:
    return point_range(ess, species, keys)
