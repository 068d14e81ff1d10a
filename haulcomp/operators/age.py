"""Population at age: an age-length key spread over the numbers at length.

With ``sim`` a specimen length that the size table lacks is left out; without, it makes the
age's total missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulcomp.functions.rules import SEX_CODE, SEXES, rdiv, replicate_keys, strict_sum
from haulcomp.operators.cells import since


def sizepop_long(size: DataFrame) -> DataFrame:
    """One row per sex (code 1, 2, 3) with its number ``sizepop``."""
    ids = [c for c in size.columns if c not in SEXES]
    long = size.unpivot(ids, SEXES, "_name", "sizepop")
    code = F.lit(None).cast("int")
    for name, value in SEX_CODE.items():
        code = F.when(F.col("_name") == name, F.lit(value)).otherwise(code)
    return long.withColumn("sex", code).drop("_name").select(*ids, "sex", "sizepop")


def age_length_key(specimen: DataFrame, pooled: bool = False) -> DataFrame:
    """Share of each age among the specimens of a length (and sex, unless pooled)."""
    at = ["year", "species_code", *([] if pooled else ["sex"]), "length"]
    counts = specimen.groupBy(*at, "age").agg(F.count(F.lit(1)).alias("age_num"))
    total = F.sum("age_num").over(Window.partitionBy(*at))
    return counts.withColumn("age_frac", rdiv(F.col("age_num"), total)).select(*at, "age", "age_frac")


def sexed_age_pop(key: DataFrame, size_long: DataFrame, sim: bool = False) -> DataFrame:
    """Males and females by age."""
    reps = replicate_keys(size_long) if sim else []
    size = size_long.select(*reps, "year", "species_code", "sex", "length", "sizepop")
    joined = key.filter(F.col("sex") <= 2).join(
        size, ["year", "species_code", "sex", "length"], "inner" if sim else "left"
    )
    total = strict_sum(F.col("age_frac") * F.col("sizepop"))
    return joined.groupBy(*reps, "year", "species_code", "sex", "age").agg(total.alias("agepop"))


def unsexed_years(specimen: DataFrame) -> DataFrame:
    """Year x species with at least one unsexed specimen."""
    return specimen.filter(F.col("sex") == SEX_CODE["unsexed"]).select("year", "species_code").distinct()


def pooled_key(specimen: DataFrame) -> DataFrame:
    """For the unsexed years, the key from all specimens whatever their sex."""
    kept = specimen.join(unsexed_years(specimen), ["year", "species_code"], "left_semi")
    return age_length_key(kept, pooled=True)


def unsexed_age_pop(key: DataFrame, size_long: DataFrame, sim: bool = False) -> DataFrame:
    """Unsexed fish by age; ``sex`` is NULL for an age none of whose lengths the size table has."""
    reps = replicate_keys(size_long) if sim else []
    size = size_long.filter(F.col("sex") == SEX_CODE["unsexed"])
    size = size.select(*reps, "year", "species_code", "length", "sizepop", F.lit(True).alias("_there"))
    joined = key.join(size, ["year", "species_code", "length"], "inner" if sim else "left")
    total = strict_sum(F.col("age_frac") * F.col("sizepop"))
    sums = joined.groupBy(*reps, "year", "species_code", "age").agg(
        F.when(F.count("_there") > 0, SEX_CODE["unsexed"]).alias("sex"), total.alias("agepop")
    )
    return sums.select(*reps, "year", "species_code", "sex", "age", "agepop")


def ages_wide(sexed: DataFrame, unsexed: DataFrame) -> DataFrame:
    """Three columns by age: 0 where a sex has no row, missing where its row is missing."""
    both = sexed.unionByName(unsexed)
    keys = [c for c in both.columns if c not in ("sex", "agepop")]

    def column(name: str):
        mine = F.col("sex") == SEX_CODE[name]
        absent = F.count_if(mine) == 0
        return F.when(absent, F.lit(0.0)).otherwise(F.max(F.when(mine, F.col("agepop")))).alias(name)

    return both.groupBy(*keys).agg(*[column(s) for s in ("unsexed", "males", "females")])


def age_pop_est(specimen: DataFrame, size: DataFrame, yrs: int | None = 2017, sim: bool = False) -> DataFrame:
    """Population at age by year and species (and replicate with ``sim``)."""
    aged = since(specimen, yrs)
    numbers = sizepop_long(size)
    sexed = sexed_age_pop(age_length_key(aged), numbers, sim)
    return ages_wide(sexed, unsexed_age_pop(pooled_key(aged), numbers, sim))
