"""Population at length, for the full data or for many replicates in one job.

Shape of the plan: catch rows shrink to one row per haul, length rows to one row per haul x
length joined to the haul's abundance, and both are staged, since several branches read them
and the raw tables should be read once. Only then, and only where the draw is random, are
rows multiplied by the replicates, in the partition they are in. What leaves it are sums per
replicate, stratum and length. Unmeasured hauls meet those sums at the end, as a histogram of
their abundances: what a haul gets at a length depends on its abundance only, also after rounding.

One run can give both levels, the whole survey and each stratum (``both``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcomp.functions.draw import SEED
from haulcomp.functions.rules import KH, SEXES, K, half_even, rdiv, sum0
from haulcomp.operators.bootstrap import REPS, Part, bootstrapped_parts
from haulcomp.operators.cells import (
    fill_grid,
    haul_cells,
    hauls_without_lengths,
    length_cells,
    length_grid,
    measured_hauls,
    since,
)
from haulcomp.operators.sampling import (
    HOT_ROWS,
    Run,
    cells_of_draws,
    draw_table,
    removed_of_draws,
    retabulate_cells,
    settled_part,
    with_runs,
    with_sims,
)
from haulcomp.session import PART_OF_KEYS, settings, stage

# A stratum's sums (replicates x lengths) and its distinct abundances meet in blocks of about these sizes.
SUMS_PER_BLOCK, ABUNDANCES_PER_BLOCK = 2_000, 2_000
GLOBAL = ["year", "species_code", "length"]
STRATA = [*K, "length"]


def _with_abundance(cells: DataFrame, hauls: DataFrame) -> DataFrame:
    """Cells with their haul's abundance, once per ``pos``; a haul without catch rows keeps a NULL one."""
    joined = cells.join(hauls.select(*KH, "pos", "abund", "copies"), KH, "left")
    return joined.fillna({"pos": 0, "copies": 1})


def _numbers(sized: DataFrame, keys: Sequence[str], strict: bool) -> DataFrame:
    """Per cell: numbers at length (sz_*), and shares of the haul (comp_*) on one of its ``pos`` rows.

    ``strict`` keeps the fish counts too, to tell a missing share from an absent sex.
    """
    cols: list[Column] = []
    for s in SEXES:
        comp = rdiv(F.col(s), F.col("tot"))
        cols.append((F.col("copies") * half_even(comp * F.col("abund"))).alias(f"sz_{s}"))
        cols.append(F.when(F.col("pos") == 0, comp).alias(f"comp_{s}"))
        if strict:
            cols.append(F.when(F.col("pos") == 0, F.col(s)).alias(f"fish_{s}"))
    return sized.select(*keys, *K, "length", *cols)


def _stratum_sums(numbers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Numbers and shares summed over hauls; with fish counts, a share is missing if that of any haul with such fish is."""
    aggs: list[Column] = []
    for s in SEXES:
        aggs.append(sum0(F.col(f"sz_{s}")).alias(f"sz_{s}"))
        share = F.sum(f"comp_{s}")
        if f"fish_{s}" in numbers.columns:
            share = F.when(F.count(f"fish_{s}") == F.count(f"comp_{s}"), share)
        aggs.append(share.alias(f"comp_{s}"))
    return numbers.groupBy(*keys, *K, "length").agg(*aggs)


def abundance_histogram(unmeasured: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many catch rows of unmeasured hauls (``_rows``) have each abundance, by stratum."""
    rows = F.sum(F.col("copies") * F.col("catches")).alias("_rows")
    return unmeasured.groupBy(*by, *K, F.col("abund").alias("_abund")).agg(rows)


def _blocks(sized: DataFrame, hist: DataFrame, by: Sequence[str], repeats: int) -> DataFrame:
    """Per stratum: measured hauls, and into how many parts its sums and its abundances are cut."""
    mine = sized.groupBy(*by, *K).agg(
        F.sum(F.when(F.col("pos") == 0, F.col("first"))).alias("nhauls"), F.count_distinct("length").alias("_lengths")
    )
    theirs = hist.groupBy(*by, *K).agg(F.count(F.lit(1)).alias("_abundances"))
    both = mine.join(theirs, [*by, *K], "left").fillna({"_abundances": 0})
    parts = F.ceil(F.col("_lengths") * repeats / SUMS_PER_BLOCK).cast("int")
    return both.select(*by, *K, "nhauls", parts.alias("_parts"), F.ceil(F.col("_abundances") / ABUNDANCES_PER_BLOCK).cast("int").alias("_slices"))


def _with_unmeasured(
    sums: DataFrame, reps: Sequence[str], sized: DataFrame, unmeasured: DataFrame, by: Sequence[str], out: Sequence[str], repeats: int
) -> DataFrame:
    """Add what the unmeasured hauls hold, at their stratum's mean composition, and sum by ``out``.

    A stratum's sums meet its histogram on (stratum, part of the sums, slice of the histogram), so a join key holds
    one block of either, however many replicates or hauls there are; slice -1 stands for the measured part.
    """
    hist = stage(abundance_histogram(unmeasured, by), "abundances")
    blocks = stage(_blocks(sized, hist, by, repeats), "blocks")
    part = F.pmod(F.xxhash64(*reps, "length"), F.col("_parts")).cast("int")
    mine = sums.join(blocks, [*by, *K]).withColumns({"_part": part, "_slice": F.explode(F.sequence(F.lit(-1), F.col("_slices") - 1))})
    theirs = hist.join(blocks.drop("nhauls"), [*by, *K]).select(
        *by,
        *K,
        "_abund",
        "_rows",
        F.pmod(F.xxhash64("_abund"), F.col("_slices")).cast("int").alias("_slice"),
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
    )
    joined = mine.join(theirs, [*by, *K, "_part", "_slice"], "left")
    aggs = []
    for s in SEXES:
        comp = F.try_divide(F.col(f"comp_{s}"), F.col("nhauls"))
        imputed = F.col("_rows") * half_even(comp * F.col("_abund"))
        aggs.append(sum0(F.when(F.col("_slice") == -1, F.col(f"sz_{s}")).otherwise(imputed)).alias(s))
    return joined.groupBy(*reps, *out).agg(*aggs)


def both_levels(strata: DataFrame, reps: Sequence[str]) -> DataFrame:
    """Numbers by stratum, and in the same pass their sums over strata: ``stratum`` is missing there and ``whole`` true."""
    keys = [*reps, *STRATA]
    sums = [F.sum(s).alias(s) for s in SEXES]
    sets = strata.groupingSets([keys, [*reps, *GLOBAL]], *keys)
    return sets.agg(*sums, (F.grouping("stratum") == 1).alias("whole"))


@dataclass(frozen=True)
class Basis:
    """What an estimate starts from, staged: cells with abundance, hauls, and the unmeasured ones among them."""

    sized: DataFrame
    unmeasured: DataFrame
    runs: Sequence[Run] | None
    by: Sequence[str]

    @property
    def reps(self) -> list[str]:
        return [] if self.runs is None else REPS

    @property
    def repeats(self) -> int:
        """Replicates that share a row of the cells."""
        return 1 if self.runs is None or self.by else sum(r.iters for r in self.runs)


def _cells(rows: DataFrame, hauls: DataFrame, runs: Sequence[Run] | None, by: Sequence[str] = ()) -> DataFrame:
    if runs is not None:
        rows = rows.filter(F.col("frequency") > 0)
    return stage(_with_abundance(length_cells(rows, by), hauls), "cells")


def _cells_of_part(part: Part, hauls: DataFrame, runs: Sequence[Run], by: Sequence[str]) -> DataFrame:
    """The cells of bootstrapped rows; the hauls go to where the rows of their stratum are, and no cell moves."""
    if part.tasks is None:
        return _cells(part.rows, hauls, runs, by)
    with settings(hauls.sparkSession, PART_OF_KEYS):
        return _cells(part.rows, hauls.repartition(part.tasks, *K), runs, by)


def basis(lfreq: DataFrame | Iterable[Part], cpue: DataFrame, runs: Sequence[Run] | None = None, by: Sequence[str] = ()) -> Basis:
    """From length rows (one set, or parts with one per replicate ``by``) and catch rows.

    Without ``runs`` the frequencies count as they are. With ``runs`` the sexed fish of each haul are to be
    cut to the run's sample size.
    """
    hauls = stage(haul_cells(cpue), "hauls")
    if isinstance(lfreq, DataFrame):
        sized = _cells(lfreq, hauls, runs, by)
    else:
        sized = reduce(DataFrame.unionByName, [_cells_of_part(p, hauls, runs, by) for p in lfreq])
    caught = with_sims(with_runs(hauls, runs)) if by else hauls
    return Basis(sized, hauls_without_lengths(caught, measured_hauls(sized, by), by), runs, by)


def numbers(b: Basis, drawn: DataFrame | None, out: Sequence[str]) -> DataFrame:
    """Numbers at length summed by ``out``; ``drawn`` are the replicated cells of hauls that are cut."""
    if b.runs is None:
        sums = _stratum_sums(_numbers(b.sized, b.by, strict=True), b.by)
    else:
        settled_keys = [k for k in ["run", "ss", "_iters", "sim"] if k != ("_iters" if b.by else "sim")]
        settled = _stratum_sums(_numbers(settled_part(b.sized, b.runs), settled_keys, strict=False), settled_keys)
        sums = _stratum_sums(_numbers(drawn, REPS, strict=False).unionByName(with_sims(settled)), REPS)
    return _with_unmeasured(sums, b.reps, b.sized, b.unmeasured, b.by, out, b.repeats)


def _on_grid(grid: DataFrame, found: DataFrame, b: Basis) -> DataFrame:
    if b.runs is not None:
        grid = with_sims(with_runs(grid, b.runs)).select(*REPS, *grid.columns)
    return fill_grid(grid, found)


def _drawn(b: Basis, seed: int, hot_rows: int) -> DataFrame | None:
    return None if b.runs is None else retabulate_cells(b.sized, b.runs, seed, hot_rows)


def estimate(
    lfreq: DataFrame | Iterable[Part],
    cpue: DataFrame,
    grid: DataFrame,
    runs: Sequence[Run] | None = None,
    by: Sequence[str] = (),
    by_stratum: bool = False,
    seed: int = SEED,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Numbers at length on the grid; with ``runs`` the result has run, ss and sim."""
    b = basis(lfreq, cpue, runs, by)
    return _on_grid(grid, numbers(b, _drawn(b, seed, hot_rows), STRATA if by_stratum else GLOBAL), b)


def estimate_both(
    lfreq: DataFrame,
    cpue: DataFrame,
    yrs: int | None = 2017,
    runs: Sequence[Run] | None = None,
    seed: int = SEED,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(numbers at length, the same by stratum) from one draw and one pass; each equals its own ``estimate``."""
    b = basis(since(lfreq, yrs), since(cpue, yrs), runs)
    strata = numbers(b, _drawn(b, seed, hot_rows), STRATA)
    found = stage(both_levels(strata, b.reps), "levels")
    whole = found.filter("whole").drop("whole", "stratum")
    each = found.filter("NOT whole").drop("whole")
    return _on_grid(length_grid(lfreq, yrs), whole, b), _on_grid(length_grid(lfreq, yrs, True), each, b)


def resampled_with_removed(
    lfreq: DataFrame,
    cpue: DataFrame,
    runs: Sequence[Run],
    yrs: int | None = 2017,
    by_stratum: bool = False,
    seed: int = SEED,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(numbers at length, fish moved to unsexed), both with run, ss and sim, from one staged draw."""
    b = basis(since(lfreq, yrs), since(cpue, yrs), runs)
    draws = draw_table(b.sized, runs, seed, hot_rows)
    found = numbers(b, cells_of_draws(draws), STRATA if by_stratum else GLOBAL)
    return _on_grid(length_grid(lfreq, yrs, by_stratum), found, b), removed_of_draws(draws)


def pop_est(
    lfreq: DataFrame,
    cpue: DataFrame,
    samples: int | None = None,
    yrs: int | None = 2017,
    by_stratum: bool = False,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame | None]:
    """(numbers at length, fish made unsexed by the cut or None)."""
    if samples is None:
        grid = length_grid(lfreq, yrs, by_stratum)
        return estimate(since(lfreq, yrs), since(cpue, yrs), grid, by_stratum=by_stratum), None
    size, fish = resampled_with_removed(lfreq, cpue, [Run(samples)], yrs, by_stratum, seed)
    return size.drop(*REPS), fish.drop(*REPS)


def resampled(
    lfreq: DataFrame,
    cpue: DataFrame,
    runs: Sequence[Run],
    yrs: int | None = 2017,
    by_stratum: bool = False,
    seed: int = SEED,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Numbers at length for every replicate of every run, with run, ss and sim."""
    grid = length_grid(lfreq, yrs, by_stratum)
    return estimate(since(lfreq, yrs), since(cpue, yrs), grid, runs, (), by_stratum, seed, hot_rows)


def bootstrapped(
    lfreq: DataFrame,
    cpue: DataFrame,
    runs: Sequence[Run],
    yrs: int | None = None,
    by_stratum: bool = False,
    seed: int = SEED,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """As ``resampled``, each replicate on its own bootstrap of hauls and lengths.

    Draws are hashes, so nothing of the size of rows x replicates is written: what is staged are haul x length cells.
    """
    grid = length_grid(lfreq, yrs, by_stratum)
    rows = bootstrapped_parts(since(lfreq, yrs), runs, seed)
    return estimate(rows, since(cpue, yrs), grid, runs, REPS, by_stratum, seed, hot_rows)
