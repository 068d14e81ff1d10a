"""The k smallest keys of groups of any size, by counting key prefixes.

Keys are hexadecimal text, evenly spread. They are counted by their first digits, with partial sums, so
a group sends one row per prefix and task. The prefix in which the k-th key falls is the cut: keys under smaller
prefixes are among the smallest, keys under larger ones are not, and only keys under the cut itself are ranked. Where more
than ``RANK_ROWS`` keys are under it, they are counted again by more digits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcomp.session import stage

# Digits by which a round of counting goes deeper; 16 ** DIGITS counts of a group meet in one window.
DIGITS = 4
# Keys of one group that are ranked in one task.
RANK_ROWS = 100_000
KEY_DIGITS = 32


def _prefix(digits: Column | int) -> Column:
    return F.substring(F.col("_key"), F.lit(1), F.lit(digits) if isinstance(digits, int) else digits)


def _cut(counts: DataFrame, group: Sequence[str], most: str = "_k") -> DataFrame:
    """Of the counts (``_prefix``, ``_in``, ``_start`` keys before all of them), the row in which the ``_k``-th key falls."""
    upto = F.sum("_in").over(Window.partitionBy(*group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_before", F.col("_start") + upto - F.col("_in"))
    hit = (F.col("_before") < F.col(most)) & (F.col(most) <= F.col("_before") + F.col("_in"))
    return placed.filter(hit).select(*group, "_prefix", "_before", "_in", "_k")


def cut_prefix(rows: Callable[[DataFrame | None], DataFrame], group: Sequence[str], k: Column) -> DataFrame:
    """Per group the ``_prefix`` in which its k-th key falls and the number of keys ``_before`` it; none where k is 0.

    ``rows(None)`` are all rows with ``_key``, ``rows(cut)`` those of the groups in ``cut``, with its columns.
    """
    counted = rows(None).withColumn("_k", k).groupBy(*group, _prefix(DIGITS).alias("_prefix"))
    counts = counted.agg(F.count(F.lit(1)).alias("_in"), F.max("_k").alias("_k")).withColumn("_start", F.lit(0).cast("bigint"))
    cut, digits = stage(_cut(counts, group), "cut"), DIGITS
    while digits < KEY_DIGITS and not (wide := cut.filter(F.col("_in") > RANK_ROWS)).isEmpty():
        under = rows(wide.select(*group, "_prefix", "_before")).filter(_prefix(digits) == F.col("_prefix")).withColumn("_k", k)
        digits += DIGITS
        counted = under.groupBy(*group, "_before", _prefix(digits).alias("_deeper"))
        deeper = counted.agg(F.count(F.lit(1)).alias("_in"), F.max("_k").alias("_k"))
        deeper = deeper.withColumnsRenamed({"_before": "_start", "_deeper": "_prefix"})
        cut = stage(cut.filter(F.col("_in") <= RANK_ROWS).unionByName(_cut(deeper, group)), "cut")
    return cut.select(*group, "_prefix", "_before")


def up_to_cut(rows: DataFrame, group: Sequence[str], k: Column, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The k smallest rows of each group in ``order``, whose first column is ``_key``; ``rows`` carry the group's cut.

    What is at or under the cut is staged: k rows of a group and the few that share the cut.
    """
    own = _prefix(F.length("_prefix"))
    near = rows.filter(own <= F.col("_prefix")).withColumn("_need", k - F.col("_before"))
    near = near.withColumn("_sure", own < F.col("_prefix"))
    near = stage(near.select(*dict.fromkeys([*group, *order, *keep]), "_sure", "_need"), "near-cut")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    edge = near.filter(~F.col("_sure")).withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_need")).drop("_rank")
    return near.filter("_sure").unionByName(edge).select(*dict.fromkeys([*group, *keep]))
