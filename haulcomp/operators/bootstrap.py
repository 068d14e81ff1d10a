"""Resampling length rows with replacement: hauls within a stratum, then lengths within the new hauls.

Rows of a stratum are numbered without bringing the stratum together: they are ordered by
a hash, counted by hash prefix, and numbered within each prefix. Donors are written once as
blocks, the hauls of 2 ** ``BLOCK_BITS`` consecutive numbers in an array.

``bootstrapped_rows`` draws hauls once and lengths in the same pass: a new haul's takers become one row, which holds both their lengths and
their draws. New hauls of donors with more than ``BIG`` rows draw by running counts instead, spread over salts.

What is moved for it is each row once, however many replicates there are: rows and donors of a stratum go to one task, and that task makes
the replicates, finds the donors and puts the new hauls together. A stratum of more than ``LARGE`` rows takes its own road: a taker finds
its donor by (stratum, block) and place, so takers spread evenly over the blocks, and are then dealt out by their new haul.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcomp.functions.draw import SEED, draw_bits, index_of, key_text
from haulcomp.functions.rules import KH, REPLICATE, K, explode_spread, explode_to
from haulcomp.operators.sampling import Run, with_runs, with_sims
from haulcomp.session import stage

ROW = ["hauljoin", "sex", "length", "frequency"]
# Hex digits of the hash that split a stratum's rows: 16 ** 3 = 4096 parts.
PREFIX = 3
REPS = REPLICATE[1:]
# Join keys a haul is spread over when its rows draw their lengths.
SALTS = 16
# Bits of a donor's place in its block, and rows of a haul up to which its new hauls are put together in one row each.
BLOCK_BITS = 13
BIG = 50_000
# Rows of a stratum up to which one task draws for it, and the takers (rows x replicates) of a stratum made at a time.
LARGE = 1_000_000
STRATUM_TAKERS = 16_000_000
# Takers per task on average.
TASK_TAKERS = 2_000_000
# Copies of a row that are made where the row is.
COPIES = 16_384


def row_blocks(lfreq: DataFrame) -> DataFrame:
    """Distinct rows of each stratum; copies of it are numbered start + 1 .. start + copies out of ``n``.

    Rows are ordered by (md5 of the row, row).
    """
    row_hash = F.md5(key_text(*[F.col(c) for c in ROW]))
    rows = lfreq.groupBy(*K, *ROW).agg(F.count(F.lit(1)).alias("copies")).withColumn("_prefix", F.substring(row_hash, 1, PREFIX))
    prefixes = rows.groupBy(*K, "_prefix").agg(F.sum("copies").alias("_copies"))
    earlier = Window.partitionBy(*K).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = prefixes.select(
        *K,
        "_prefix",
        F.coalesce(F.sum("_copies").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_copies").over(Window.partitionBy(*K)).alias("n"),
    )
    within = Window.partitionBy(*K, "_prefix").orderBy("_hash", *ROW).rowsBetween(Window.unboundedPreceding, -1)
    # Moved once, without the hash, to where both the window and the join find them.
    rows = rows.repartition(*K, "_prefix").withColumn("_hash", row_hash)
    rows = rows.withColumn("_within", F.coalesce(F.sum("copies").over(within), F.lit(0))).drop("_hash")
    joined = rows.join(offsets, [*K, "_prefix"])
    return joined.select(*K, *ROW, "copies", (F.col("_before") + F.col("_within")).alias("start"), "n")


@dataclass(frozen=True)
class Numbered:
    """Length rows with their ``ordinal`` 1..n in their stratum: their number, and the rows of the largest stratum."""

    rows: DataFrame
    total: int
    most: int


def _numbered(lfreq: DataFrame) -> Numbered:
    """The rows that ``row_blocks`` stands for; the blocks are staged, the rows are not."""
    blocks = stage(row_blocks(lfreq), "numbered-rows")
    size = blocks.agg(F.sum("copies").alias("total"), F.max("n").alias("most"), F.max("copies").alias("copies")).first()
    few = blocks.filter(F.col("copies") <= COPIES)
    rows = explode_to(few, F.col("copies"), "_copy", COPIES)
    if (size.copies or 0) <= 1:
        rows = blocks.withColumn("_copy", F.lit(1))
    elif size.copies > COPIES:
        rows = rows.unionByName(explode_spread(blocks.filter(F.col("copies") > COPIES), F.col("copies"), "_copy"))
    rows = rows.withColumn("ordinal", F.col("start") + F.col("_copy")).drop("start", "_copy", "copies")
    return Numbered(rows, size.total or 0, size.most or 0)


def numbered_rows(lfreq: DataFrame) -> DataFrame:
    """Every length row with its ``ordinal`` 1..n in its stratum."""
    return _numbered(lfreq).rows


def donor_blocks(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The hauls of numbered rows by stratum and ``_block`` of consecutive numbers, staged; ``_big`` marks those with many rows.

    Tells too whether there are such hauls.
    """
    # At most one in BIG rows.
    big = stage(rows.groupBy(*KH).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BIG).drop("_n"), "big-hauls")
    marked, any_big = rows.withColumn("_big", F.lit(False)), not big.isEmpty()
    if any_big:
        marked = rows.join(big.withColumn("_big", F.lit(True)), KH, "left").fillna({"_big": False})
    donor = F.sort_array(F.collect_list(F.struct("ordinal", "hauljoin", "_big")))
    blocks = marked.groupBy(*K, F.shiftright(F.col("ordinal") - 1, BLOCK_BITS).alias("_block")).agg(donor.alias("_d"), F.max("n").alias("n"))
    return stage(blocks.select(*K, "_block", "n", F.col("_d.hauljoin").alias("_hauls"), F.col("_d._big").alias("_bigs")), "donors"), any_big


def _donor_number(seed: int) -> Column:
    """The number, from 0, of the row whose haul a row gets."""
    who = [F.col(c) for c in [*REPS, *K, "ordinal"]]
    # Never missing (n is 1 at least), and the plan can tell: a test for it below the join would hash every row again.
    return F.coalesce(index_of(draw_bits(seed, "haul", *who), F.col("n")) - 1, F.lit(0).cast("bigint"))


DRAWN = [*REPS, *K, "hauljoin", "ordinal", "sex", "length", "frequency", "_big"]


def _drawn_by_block(rows: DataFrame, donors: DataFrame, runs: Sequence[Run], seed: int) -> DataFrame:
    """``bootstrap_hauls`` with ``_big``, for strata of any size."""
    takers = with_sims(with_runs(rows.drop("hauljoin"), runs))
    takers = takers.withColumn("_drawn", _donor_number(seed)).drop("n")
    met = takers.withColumn("_block", F.shiftright("_drawn", BLOCK_BITS)).join(donors.drop("n"), [*K, "_block"])
    place = F.col("_drawn").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    return met.withColumns({"hauljoin": F.get("_hauls", place), "_big": F.get("_bigs", place)}).select(*DRAWN)


def _drawn_in_stratum(rows: DataFrame, donors: DataFrame, reps: Sequence[tuple[int, int, int]], seed: int, tasks: int) -> DataFrame:
    """The same for the replicates (run, ss, sim), made where the rows of their stratum are; stays partitioned by stratum."""
    blocks = F.sort_array(F.collect_list(F.struct("_block", "_hauls", "_bigs")))
    whole = donors.repartition(tasks, *K).groupBy(*K).agg(blocks.alias("_d"))
    whole = whole.select(*K, F.flatten("_d._hauls").alias("_hauls"), F.flatten("_d._bigs").alias("_bigs"))
    # The arrays of a stratum stand beside each of its rows without being copied: the rows leave with what they found there.
    met = rows.drop("hauljoin").repartition(tasks, *K).join(whole, K)
    each = [F.struct(*[F.lit(v).alias(c) for c, v in zip(REPS, rep)]) for rep in reps]
    takers = met.select("*", F.inline(F.array(*each))).withColumn("_drawn", _donor_number(seed).cast("int"))
    return takers.withColumns({"hauljoin": F.get("_hauls", F.col("_drawn")), "_big": F.get("_bigs", F.col("_drawn"))}).select(*DRAWN)


def bootstrap_hauls(lfreq: DataFrame, runs: Sequence[Run], seed: int = SEED) -> DataFrame:
    """Per replicate, each length row gets the haul of a row of its stratum drawn with replacement."""
    rows = _numbered(lfreq).rows
    return _drawn_by_block(rows, donor_blocks(rows)[0], runs, seed).drop("_big")


def _length_bits(seed: int) -> Column:
    return draw_bits(seed, "length", *[F.col(c) for c in [*REPS, *K, "ordinal"]])


def _lengths_in_row(rows: DataFrame, seed: int) -> DataFrame:
    """``bootstrap_lengths`` where a haul's rows fit in one; ``rows`` have the rows of a haul in one partition."""
    taker = F.struct("ordinal", "sex", "length", "frequency", _length_bits(seed).alias("bits"))
    hauls = rows.groupBy(*REPS, *KH).agg(F.collect_list(taker).alias("_takers"))

    def given(lengths: Column) -> Column:
        def one(t: Column) -> Column:
            length = F.get(lengths, F.try_mod(t["bits"], F.size(lengths)).cast("int"))
            return F.struct(t["ordinal"].alias("ordinal"), t["sex"].alias("sex"), length.alias("length"), t["frequency"].alias("frequency"))

        return F.transform("_takers", one)

    # The lengths are sorted once and held by the outer lambda.
    lengths = F.sort_array(F.transform("_takers", lambda t: t["length"]))
    return hauls.select(*REPS, *KH, F.inline(F.transform(F.array(lengths), given)[0]))


@dataclass(frozen=True)
class Part:
    """Bootstrapped rows; all rows of a haul and replicate are in one part. ``tasks``: partitioned by stratum into so many."""

    rows: DataFrame
    tasks: int | None = None


def bootstrapped_parts(lfreq: DataFrame, runs: Sequence[Run], seed: int = SEED) -> Iterator[Part]:
    """``bootstrapped_rows`` in parts, of which a caller may finish one before it asks for the next."""
    numbered = _numbered(lfreq)
    donors, any_big = donor_blocks(numbered.rows)
    large, spark = F.col("n") > LARGE, lfreq.sparkSession

    def finished(drawn: DataFrame, tasks: int | None) -> Iterator[Part]:
        # By sim and haul only: a label that is the same on all rows is no key to the planner, and rows would move again.
        few = drawn.filter(~F.col("_big")) if any_big else drawn
        few = few.drop("_big") if tasks else few.drop("_big").repartition("sim", *KH)
        yield Part(_lengths_in_row(few, seed), tasks)
        if any_big:
            yield Part(bootstrap_lengths(drawn.filter("_big").drop("_big"), seed))

    reps = [(r.label, r.size, sim) for r in runs for sim in range(1, r.iters + 1)]
    at_once = max(1, STRATUM_TAKERS // max(1, min(numbered.most, LARGE)))
    cores = spark.sparkContext.defaultParallelism
    for some in [reps[i : i + at_once] for i in range(0, len(reps), at_once)]:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-numbered.total * len(some) // TASK_TAKERS))
        tasks = -(-tasks // cores) * cores
        yield from finished(_drawn_in_stratum(numbered.rows.filter(~large), donors.filter(~large), some, seed, tasks), tasks)
    if numbered.most > LARGE:
        yield from finished(_drawn_by_block(numbered.rows.filter(large), donors.filter(large), runs, seed), None)


def bootstrapped_rows(lfreq: DataFrame, runs: Sequence[Run], seed: int = SEED) -> DataFrame:
    """Hauls, then lengths, drawn with replacement: ``bootstrap_lengths`` of ``bootstrap_hauls``, with one draw of hauls."""
    parts = [p.rows for p in bootstrapped_parts(lfreq, runs, seed)]
    return reduce(DataFrame.unionByName, parts)


def bootstrap_lengths(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Each row gets the length of a row of its (new) haul drawn with replacement.

    A haul becomes one row: its lengths with running counts, as many as there are length bins. That row is repeated
    for SALTS join keys, the haul's rows are dealt to them by ordinal, and each takes the first length whose running
    count reaches its draw. As the salt is part of the key, what follows has a shuffle of its own, so
    Spark may split a key that is still too large.
    """
    counts = rows.groupBy(*REPS, *KH, "length").agg(F.count(F.lit(1)).alias("_n"))
    haul = counts.groupBy(*REPS, *KH).agg(F.sort_array(F.collect_list(F.struct("length", "_n"))).alias("_lengths"), F.sum("_n").alias("_rows"))
    zero = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("int").alias("length"))
    # The running count passes the draw at one length only; that length is kept on the way.
    spans = haul.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Hashed below the join, so that comparing with each length does not hash again.
    hashed = rows.drop("length").withColumns({"_bits": _length_bits(seed), "_salt": (F.col("ordinal") % SALTS).cast("int")})
    hit = hashed.join(spans, [*REPS, *KH, "_salt"]).withColumn("_drawn", index_of(F.col("_bits"), F.col("_rows")))

    def step(state, x):
        upto = state["upto"] + x["_n"]
        here = (state["upto"] < F.col("_drawn")) & (F.col("_drawn") <= upto)
        return F.struct(upto.alias("upto"), F.when(here, x["length"]).otherwise(state["length"]).alias("length"))

    length = F.aggregate("_lengths", zero, step)["length"].alias("length")
    return hit.select(*REPS, *KH, "ordinal", "sex", length, "frequency")
