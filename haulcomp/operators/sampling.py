"""Cutting the sexed sample of a haul to ``samples`` fish, for many replicates at once.

Fish are drawn by the rank of a portable hash (functions.draw). Where a haul has no more
sexed fish than the sample size nothing is random and nothing is replicated. Replicates of
the other hauls are made and ranked in the partition that already holds the haul, without
a shuffle. A haul with too many fish for that takes its own road: its fish are cut
into chunks that are spread over the cluster, keys are counted by prefix, and only the fish
under the prefix in which the last drawn key falls are ranked (operators.selection).

``draw_table`` keeps which fish were drawn, so that numbers at length and removed fish can be
read off one draw.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcomp.functions.draw import SEED, key_text, rank_key
from haulcomp.functions.rules import KH, SEX_CODE, SEXES, K, explode_spread, explode_to, required
from haulcomp.operators.cells import length_cells
from haulcomp.operators.selection import cut_prefix, up_to_cut
from haulcomp.session import stage

# The label of a run that keeps every fish; no sample size.
EVERY_FISH = -1
# Fish x replicates of one haul that one task may rank; a haul with more is spread.
HOT_ROWS = 4_000_000
CHUNK = 16_384
# Fish x replicates per task on average.
TASK_FISH = 1_000_000
# Parts of a replicate's stratum, by haul, in which a bootstrap's fish are ranked.
SLICES = 8


@dataclass(frozen=True)
class Run:
    """``iters`` independent replicates at one sample size; the label keeps runs independent of each other."""

    samples: int | None
    iters: int = 1
    label: int = 0

    @property
    def size(self) -> int:
        return EVERY_FISH if self.samples is None else self.samples


def with_runs(df: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """Each row once per run, with run, ss and _iters; a single run adds constants only.

    Rows that belong to a replicate already (bootstrap) stay as they are.
    """
    if "ss" in df.columns:
        return df
    if len(runs) == 1:
        r = runs[0]
        return df.withColumns({"run": F.lit(r.label), "ss": F.lit(r.size), "_iters": F.lit(r.iters)})
    specs = [F.struct(F.lit(r.label).alias("run"), F.lit(r.size).alias("ss"), F.lit(r.iters).alias("_iters")) for r in runs]
    return df.select("*", F.inline(F.array(*specs)))


def with_sims(df: DataFrame) -> DataFrame:
    """Each row once per replicate of its run, unless the rows belong to a replicate already."""
    if "sim" in df.columns:
        return df.drop("_iters")
    return df.withColumn("sim", F.explode(F.sequence(F.lit(1), F.col("_iters")))).drop("_iters")


def fish_id() -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in [*KH, "sex", "length", "ordinal"]])


def uncount(df: DataFrame) -> DataFrame:
    """One row per fish: ``frequency`` becomes ``ordinal`` 1..frequency; a frequency of 0 leaves no row."""
    return explode_spread(df.withColumn("frequency", required("frequency")), F.col("frequency"), "ordinal").drop("frequency")


def _sexed_count() -> Column:
    return F.coalesce(F.col("males"), F.lit(0)) + F.coalesce(F.col("females"), F.lit(0))


def _one_sex_each(cells: DataFrame) -> DataFrame:
    """Cells once per sex they hold, with sex, the number ``_n`` of such fish, and their id up to the ordinal."""
    sexed = [F.struct(F.lit(SEX_CODE[s]).alias("sex"), F.col(s).cast("bigint").alias("_n")) for s in SEXES[:2]]
    rows = cells.select("*", F.inline(F.array(*sexed))).filter(F.col("_n") > 0)
    return rows.withColumn("_id", key_text(*[F.col(c) for c in [*KH, "sex", "length"]]))


def _keyed_fish(rows: DataFrame, ordinals: Column, seed: int) -> DataFrame:
    """Rows x sims to fish with ordinal and rank key; all of the key but the ordinal is put together once per row."""
    text = key_text(seed, "fish", F.col("run"), F.col("ss"), F.col("sim"), F.col("_id"))
    fish = rows.withColumn("_text", text).withColumn("ordinal", F.explode(ordinals))
    return fish.withColumn("_key", rank_key(F.col("_text"), F.col("ordinal"))).drop("_text")


def random_part(cells: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """Cells x runs whose sexed fish must be drawn."""
    return with_runs(cells, runs).filter((F.col("ss") >= 0) & (F.col("sexed") > F.col("ss")) & (_sexed_count() > 0))


def settled_part(cells: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """Cells x runs that every replicate shares: all fish kept, or none of them sexed."""
    return with_runs(cells, runs).filter((F.col("ss") < 0) | (F.col("sexed") <= F.col("ss")) | (_sexed_count() == 0))


def _haul_keys(cells: DataFrame) -> list[str]:
    """What a draw is made over; the haul first, as it tells most rows apart."""
    return ["hauljoin", "species_code", "sim", "ss", "run", "year", "stratum", *(["pos"] if "pos" in cells.columns else [])]


ORDER = ["_key", "sex", "length", "ordinal"]


def _split(cells: DataFrame, runs: Sequence[Run], hot_rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(ordinary, hot or None, tasks): ``random_part`` by whether a haul's fish x replicates fit in a task.

    ``cells`` are staged, as they are read several times; they may carry further columns, and
    ``pos`` (a repeated haul) is ranked by itself.
    """
    # The repeats one task would hold: bootstrap cells come one replicate at a time.
    repeats = 1 if "sim" in cells.columns else sum(r.iters for r in runs)
    cells = random_part(cells, runs)
    # What the rows grow to is not in the sizes AQE would merge partitions by, so their number follows from the fish.
    size = cells.agg(F.sum(_sexed_count()).alias("fish"), F.max("sexed").alias("most")).first()
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size.fish or 0) * repeats // TASK_FISH))
    # Whole rounds of all cores, so that no last round runs on a few of them.
    cores = cells.sparkSession.sparkContext.defaultParallelism
    tasks = -(-tasks // cores) * cores
    hot = F.col("sexed") > hot_rows // repeats
    return cells.filter(~hot), cells.filter(hot) if (size.most or 0) > hot_rows // repeats else None, tasks


def _ordinary_fish(cells: DataFrame, tasks: int, seed: int) -> DataFrame:
    """Each sexed fish per replicate with ``drawn``, ranked where its haul is."""
    if own := _slice(cells):
        # By stratum and slice, so that a task's sums by stratum are few, however many hauls there are.
        cells = cells.withColumn("_slice", F.pmod(F.xxhash64("hauljoin"), F.lit(SLICES)).cast("int"))
    together = with_sims(_one_sex_each(cells.repartition(tasks, *(["ss", "sim", *K, *own] if own else KH))))
    fish = _keyed_fish(together, F.expr("sequence(1L, _n)"), seed)
    rank = F.row_number().over(Window.partitionBy(*_haul_keys(cells), *own).orderBy(*ORDER))
    return fish.withColumn("drawn", rank <= F.col("ss")).drop("_key")


def _slice(cells: DataFrame) -> list[str]:
    """A bootstrap's cells belong to a replicate already; their hauls are dealt out by slices of the replicate's strata."""
    return ["_slice"] if "sim" in cells.columns else []


def _chunk_end() -> Column:
    return F.least(F.col("_n"), (F.col("_part") + 1) * CHUNK)


def _hot_draws(cells: DataFrame, tasks: int, seed: int) -> DataFrame:
    """Chunks of the hot hauls' fish per replicate with ``_drawn``, the ordinals drawn in the chunk."""
    haul = _haul_keys(cells)
    chunk_no = F.explode(F.expr(f"sequence(0L, (_n - 1) div {CHUNK})"))
    chunks = with_sims(_one_sex_each(cells).withColumn("_part", chunk_no))
    spot = ["sex", "length", "_part"]

    def fish(cut: DataFrame | None) -> DataFrame:
        # The cut meets chunks, not fish, and what it meets is spread by chunk.
        some = chunks if cut is None else chunks.join(cut, haul)
        kept = [*haul, *spot, "_n", "_id", *(["_prefix", "_before"] if cut is not None else [])]
        in_chunk = F.sequence(F.col("_part") * CHUNK + 1, _chunk_end())
        return _keyed_fish(some.select(*kept).repartition(tasks, *haul, *spot), in_chunk, seed)

    cut = cut_prefix(fish, haul, F.col("ss"))
    drawn = up_to_cut(fish(cut), haul, F.col("ss"), ORDER, [*spot, "ordinal"])
    lists = drawn.groupBy(*haul, *spot).agg(F.collect_list("ordinal").alias("_drawn"))
    none = F.expr("cast(array() as array<bigint>)")
    return chunks.join(lists, [*haul, *spot], "left").withColumn("_drawn", F.coalesce("_drawn", none))


def rank_fish(cells: DataFrame, runs: Sequence[Run], seed: int, hot_rows: int = HOT_ROWS) -> list[DataFrame]:
    """The fish of ``random_part`` per replicate with ``drawn``: ordinary hauls, then hot ones if there are any."""
    ordinary, hot, tasks = _split(cells, runs, hot_rows)
    parts = [_ordinary_fish(ordinary, tasks, seed)]
    if hot is not None:
        draws = _hot_draws(hot, tasks, seed)
        rest = F.array_except(F.sequence(F.col("_part") * CHUNK + 1, _chunk_end()), F.col("_drawn"))

        def marked(ordinals: Column, drawn: bool) -> Column:
            return F.transform(ordinals, lambda o: F.struct(o.alias("ordinal"), F.lit(drawn).alias("drawn")))

        fish = draws.select("*", F.inline(F.concat(marked(F.col("_drawn"), True), marked(rest, False))))
        parts.append(fish.select(parts[0].columns))
    return parts


def _cell_payload(cells: DataFrame) -> list[Column]:
    return [F.max(c).alias(c) for c in ("_all", "tot", "abund", "copies") if c in cells.columns]


def _with_all(cells: DataFrame) -> DataFrame:
    return cells.withColumn("_all", _sexed_count() + F.coalesce(F.col("unsexed"), F.lit(0)))


def _cell_keys(cells: DataFrame) -> list[str]:
    return ["run", "ss", "sim", *KH, *(["pos"] if "pos" in cells.columns else []), "length"]


def retabulate_cells(cells: DataFrame, runs: Sequence[Run], seed: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``random_part`` cells per replicate after the draw: fish not drawn have moved to unsexed."""
    ordinary, hot, tasks = _split(_with_all(cells), runs, hot_rows)
    fish = _ordinary_fish(ordinary, tasks, seed)
    males, females = [F.count_if(F.col("drawn") & (F.col("sex") == SEX_CODE[s])) for s in SEXES[:2]]
    out = fish.groupBy(*_cell_keys(cells), *_slice(cells)).agg(males.alias("males"), females.alias("females"), *_cell_payload(ordinary))
    out = out.withColumn("unsexed", F.col("_all") - F.col("males") - F.col("females")).drop("_all", "_slice")
    return out if hot is None else out.unionByName(cells_of_draws(_hot_draws(hot, tasks, seed)))


# ---- one draw for several results ----------------------------------------------------------


def draw_table(cells: DataFrame, runs: Sequence[Run], seed: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The draw of ``random_part``, staged: per replicate, cell, sex and chunk of its fish, the ordinals drawn (``_drawn``).

    Every fish's key is made here and nowhere after: ``cells_of_draws`` and ``removed_of_draws`` read this table.
    """
    ordinary, hot, tasks = _split(_with_all(cells), runs, hot_rows)
    fish = _ordinary_fish(ordinary, tasks, seed).withColumn("_part", F.expr(f"(ordinal - 1) div {CHUNK}"))
    drawn = F.collect_list(F.when(F.col("drawn"), F.col("ordinal"))).alias("_drawn")
    payload = [*_cell_payload(ordinary), F.max("_n").alias("_n"), F.max("sexed").alias("sexed")]
    draws = fish.groupBy(*_cell_keys(cells), "sex", "_part").agg(drawn, *payload)
    if hot is not None:
        draws = draws.unionByName(_hot_draws(hot, tasks, seed).select(draws.columns))
    return stage(draws, "draws")


def cells_of_draws(draws: DataFrame) -> DataFrame:
    """``retabulate_cells`` from the table of draws."""
    males, females = [F.sum(F.when(F.col("sex") == SEX_CODE[s], F.size("_drawn")).otherwise(0)) for s in SEXES[:2]]
    out = draws.groupBy(*_cell_keys(draws)).agg(males.alias("males"), females.alias("females"), *_cell_payload(draws))
    return out.withColumn("unsexed", F.col("_all") - F.col("males") - F.col("females")).drop("_all")


def removed_of_draws(draws: DataFrame) -> DataFrame:
    """``newly_unsexed`` from the table of draws."""
    first = draws.filter(F.col("pos") == 0) if "pos" in draws.columns else draws
    rest = F.array_except(F.sequence(F.col("_part") * CHUNK + 1, _chunk_end()), F.col("_drawn"))
    fish = first.withColumn("ordinal", F.explode(rest)).withColumns({"id": fish_id(), "n": F.col("sexed")})
    return _as_unsexed(fish)


def _as_unsexed(fish: DataFrame) -> DataFrame:
    return fish.withColumn("sex", F.lit(SEX_CODE["unsexed"])).select("run", "ss", "sim", *KH, "sex", "length", "id", "n")


def removed_counts(lfreq: DataFrame, samples: int) -> DataFrame:
    """Mean number of fish removed per haul. Every replicate moves all sexed fish beyond ``samples``, so no draw is needed."""
    sexed = lfreq.filter((F.col("frequency") > 0) & (F.col("sex") != SEX_CODE["unsexed"]))
    hauls = sexed.groupBy(*KH).agg((F.sum("frequency") - F.lit(samples)).cast("double").alias("ss_removed"))
    return hauls.filter(F.col("ss_removed") > 0)


# ---- the same steps as frames of fish ------------------------------------------------------


def fish_count(lfreq: DataFrame) -> DataFrame:
    """Fish summed by haul, sex, length, so that a fish number within them is unique."""
    kept = lfreq.filter(F.col("frequency") > 0)
    return kept.groupBy(*KH, "sex", "length").agg(F.sum("frequency").alias("frequency"))


def sample_cells(lfreq: DataFrame) -> DataFrame:
    """Staged length cells of the rows that hold fish."""
    return stage(length_cells(lfreq.filter(F.col("frequency") > 0)), "cells")


def split_sexed(lfreq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sexed, unsexed) fish with ``id`` and ``n``, the haul's number of fish of that kind."""

    def fish(part: DataFrame) -> DataFrame:
        counts = fish_count(part)
        n = F.sum("frequency").over(Window.partitionBy(*KH))
        rows = uncount(counts.withColumn("n", n))
        return rows.withColumn("id", fish_id()).select(*KH, "sex", "length", "id", "n")

    unsexed = F.col("sex") == SEX_CODE["unsexed"]
    return fish(lfreq.filter(~unsexed)), fish(lfreq.filter(unsexed))


def _sexed_fish(lfreq: DataFrame, runs: Sequence[Run], seed: int, hot_rows: int, settled: bool) -> DataFrame:
    cells = sample_cells(lfreq)
    parts = rank_fish(cells, runs, seed, hot_rows)
    if settled:
        kept = with_sims(_one_sex_each(settled_part(cells, runs)))
        kept = explode_to(kept, F.col("_n"), "ordinal").withColumn("drawn", F.lit(True))
        parts.append(kept.select(parts[0].columns))
    fish = parts[0]
    for p in parts[1:]:
        fish = fish.unionByName(p)
    return fish.withColumn("id", fish_id()).withColumn("n", F.col("sexed"))


def subsample(
    lfreq: DataFrame, samples: int | None, seed: int = SEED, iters: int = 1, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """min(n, samples) sexed fish of each haul, drawn without replacement; ``new_samp`` is that number."""
    fish = _sexed_fish(lfreq, [Run(samples, iters)], seed, hot_rows, settled=True).filter("drawn")
    return fish.withColumn("new_samp", F.when(F.col("ss") < 0, F.col("n")).otherwise(F.least(F.col("n"), F.col("ss").cast("bigint")))).select(
        "sim", *KH, "sex", "length", "id", "n", "new_samp"
    )


def newly_unsexed(lfreq: DataFrame, runs: Sequence[Run], seed: int = SEED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The sexed fish not drawn, now of sex 3; ``id`` tells what they were."""
    return _as_unsexed(_sexed_fish(lfreq, runs, seed, hot_rows, settled=False).filter(~F.col("drawn")))


def retabulate(lfreq: DataFrame, samples: int, seed: int = SEED, iters: int = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Length frequencies after the draw: by haul, sex, length and replicate."""
    from haulcomp.operators.estimate import by_sex

    runs = [Run(samples, iters)]
    cells = sample_cells(lfreq)
    cols = ["sim", *KH, "length", *SEXES]
    wide = retabulate_cells(cells, runs, seed, hot_rows).select(*cols)
    wide = wide.unionByName(with_sims(settled_part(cells, runs)).select(*cols))
    return by_sex(wide, "frequency").filter(F.col("frequency") > 0)
