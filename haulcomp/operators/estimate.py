"""The estimate step by step, one row per sex: the composable form of what plans.population fuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcomp.functions.rules import KH, SEX_CODE, SEXES, K, explode_spread, half_even, rdiv, sum0
from haulcomp.operators import cells
from haulcomp.operators.cells import haul_cells, length_cells


def by_sex(wide: DataFrame, value: str) -> DataFrame:
    """males / females / unsexed columns to rows with a sex code; an absent sex gives no row."""
    ids = [c for c in wide.columns if c not in SEXES]
    cols = F.array(*[F.struct(F.lit(SEX_CODE[s]).alias("sex"), F.col(s).alias(value)) for s in SEXES])
    return wide.select(*ids, F.inline(cols)).filter(F.col(value).isNotNull())


def haul_count(lfreq: DataFrame) -> DataFrame:
    """Hauls with lengths per year, species, stratum."""
    return lfreq.select(*KH).distinct().groupBy(*K).agg(F.count(F.lit(1)).alias("nhauls"))


def length_comp(lfreq: DataFrame) -> DataFrame:
    """Share of each sex and length in its haul's fish, with the stratum's number of measured hauls."""
    shares = by_sex(length_cells(lfreq).drop("first", "sexed"), "frequency")
    comp = shares.withColumn("comp", rdiv(F.col("frequency"), F.col("tot")))
    return comp.join(haul_count(lfreq), K).select(*KH, "sex", "length", "comp", "nhauls")


def stratum_comp(comp: DataFrame) -> DataFrame:
    """Mean composition over the stratum's measured hauls (a haul without the sex and length counts as 0)."""
    total = F.when(F.count("comp") == F.count(F.lit(1)), F.sum("comp"))
    return comp.groupBy(*K, "sex", "length").agg(F.try_divide(total, F.max("nhauls")).alias("comp"))


def haul_abundance(cpue: DataFrame) -> DataFrame:
    """Fish in the stratum that a haul stands for; one row per catch row, zero catches included."""
    return explode_spread(haul_cells(cpue), F.col("copies"), "_row").select(*KH, "abund")


def impute_comp(no_length: DataFrame, stratum: DataFrame, comp: DataFrame) -> DataFrame:
    """Measured hauls with their own composition, unmeasured ones with their stratum's.

    Hauls of a stratum are dealt to slices, and each slice has the stratum's composition, so a large stratum is spread.
    """
    cols = [*KH, "sex", "length", "comp"]
    slices = no_length.groupBy(*K).agg(F.ceil(F.count(F.lit(1)) / cells.HAULS_PER_SLICE).cast("int").alias("_slices"))
    hauls = no_length.select(*KH).join(slices, K).withColumn("_slice", F.pmod(F.xxhash64("hauljoin"), F.col("_slices")).cast("int"))
    each = stratum.join(slices, K).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    given = hauls.join(each.drop("_slices"), [*K, "_slice"], "left").select(*cols)
    return given.unionByName(comp.select(*cols))


def expand(comp: DataFrame, abund: DataFrame) -> DataFrame:
    """Composition to numbers, rounded half to even."""
    joined = comp.join(abund, KH, "left")
    return joined.withColumn("sz_pop", half_even(F.col("comp") * F.col("abund")))


def size_sum(sized: DataFrame, by_stratum: bool = False) -> DataFrame:
    keys = ["year", "species_code", *(["stratum"] if by_stratum else []), "length", "sex"]
    return sized.groupBy(*keys).agg(sum0(F.col("sz_pop")).alias("abund"))


def sexes_wide(df: DataFrame, value: str = "abund") -> DataFrame:
    """Rows with a sex code to three columns, always all three (NULL where a sex is absent)."""
    keys = [c for c in df.columns if c not in ("sex", value)]
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col("sex") == SEX_CODE[s], F.col(value))).alias(s) for s in SEXES])
