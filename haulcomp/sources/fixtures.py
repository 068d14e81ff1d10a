"""The star-schema test tables seen as survey tables.

A measured haul is one supplier in one order year, a species is a part type, a stratum is a
nation, a fish count comes from the quantity. Every line item is a length row, a catch and a
specimen. Hauls that nobody measured are the orders of one nation's customers in one month: every
order is a catch of theirs, of the species its priority names, and they have no lengths. So no view
leaves out a row of its tables, and the rules for unmeasured hauls have something to act on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Part type to species, region to survey.
SPECIES = {1: 10110, 2: 10120, 3: 10130, 4: 21720, 5: 21740, 6: 21921}
TYPES = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5}
SURVEYS = {0: "AI", 1: "GOA", 2: "EBS", 3: "BSS"}
PRIORITIES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}


def _lookup(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _survey() -> Column:
    return _lookup(F.col("n_regionkey"), SURVEYS, "NBS")


def _species(kind: Column) -> Column:
    """A haul that can't catch the species of a part has the next one instead, so each haul lacks one species."""
    return F.when((F.col("l_suppkey") + kind) % 6 == 0, kind % 6 + 1).otherwise(kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, with its haul, species, sex, length and fish count."""
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.year("o_orderdate").alias("year"),
        _species(_lookup(F.col("p_type"), TYPES, 6)).alias("sp"),
        _survey().alias("survey"),
        F.col("s_nationkey").alias("stratum"),
        (F.year("o_orderdate").cast("bigint") * 1000000 + F.col("l_suppkey")).alias("hauljoin"),
        "l_suppkey",
        _lookup(F.col("l_returnflag"), {"A": 1, "N": 2}, 3).alias("sex"),
        (F.col("p_size") * 10).alias("length"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("frequency"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        "l_linenumber",
        "l_discount",
        "p_size",
    ).withColumn("species_code", _lookup(F.col("sp"), SPECIES, 0))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        _survey().alias("survey"),
        F.col("n_nationkey").alias("stratum"),
        ((F.col("n_nationkey") + 1) * 100).cast("double").alias("area"),
    )


def lfreq(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """Length frequencies of every line item; ``items`` is a ``base`` that is at hand."""
    rows = base(spark, sf_dir) if items is None else items
    return rows.select("survey", "year", "species_code", "stratum", "hauljoin", "sex", "length", "frequency")


HAUL = ["survey", "year", "stratum", "hauljoin"]


def order_catches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a catch of an unmeasured haul; their numbers are negative, so no measured haul has one."""
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        _survey().alias("survey"),
        year.alias("year"),
        F.col("c_nationkey").alias("stratum"),
        (-(year * 10000 + month * 100 + F.col("c_nationkey"))).cast("bigint").alias("hauljoin"),
        _lookup(F.col("o_orderpriority"), PRIORITIES, 5).alias("sp"),
        (F.floor(F.col("o_totalprice") / 10000) + 1).alias("qty"),
    )


def cpue(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """Every haul x species, from the line items and the orders; a species not caught has no catchjoin."""
    rows = base(spark, sf_dir) if items is None else items
    caught = rows.select(*HAUL, "sp", "qty").unionByName(order_catches(spark, sf_dir))
    catches = caught.groupBy(HAUL).agg(*[F.sum(F.when(F.col("sp") == sp, F.col("qty"))).alias(f"q{sp}") for sp in SPECIES])
    per_species = F.array(
        *[F.struct(F.lit(sp).alias("sp"), F.lit(code).alias("code"), F.col(f"q{sp}").alias("q")) for sp, code in SPECIES.items()]
    )
    rows = catches.select(*HAUL, F.inline(per_species))
    area = strata(spark, sf_dir).select("stratum", "area")
    return rows.join(area, "stratum", "left").select(
        "survey",
        "year",
        F.col("code").alias("species_code"),
        F.when(F.col("q").isNotNull(), F.col("hauljoin") * 10 + F.col("sp")).alias("catchjoin"),
        "hauljoin",
        "stratum",
        F.coalesce(F.col("q"), F.lit(0)).cast("double").alias("numcpue"),
        "area",
    )


def specimen(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """Raw specimens, every line item: age may be missing; who sexed them left none unsexed in odd years, and took them for females."""
    rows = base(spark, sf_dir) if items is None else items
    sex = F.when((F.col("sex") == 3) & (F.col("year") % 2 == 1), 2).otherwise(F.col("sex"))
    age = F.floor(F.col("p_size") / 5).cast("int") + F.col("l_linenumber")
    return rows.select(
        F.col("survey").alias("region"),
        "year",
        "species_code",
        "stratum",
        "hauljoin",
        sex.alias("sex"),
        "length",
        F.when(F.col("l_discount") <= 0.08, age).alias("age"),
    )
