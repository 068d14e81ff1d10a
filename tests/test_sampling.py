"""Subsampling, replicates and the bootstrap: properties, hot hauls, save rules."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from haulcomp import session
from haulcomp.functions.rules import KH, explode_spread, explode_to
from haulcomp.operators import sampling, selection
from haulcomp.operators import bootstrap
from haulcomp.operators.bootstrap import bootstrap_hauls, bootstrap_lengths, bootstrapped_rows, numbered_rows
from haulcomp.operators.cells import since
from haulcomp.operators.sampling import Run
from haulcomp.plans import population, simulate
from haulcomp.sources.results import read_result

A = 10110


def test_uncount_drops_zero_and_cuts_big_rows(spark, table):
    lfreq = table("lfreq", [(2001, A, 1, 11, 1, 50, 0), (2001, A, 1, 11, 1, 60, 3)])
    assert rows(sampling.uncount(lfreq), "length", "ordinal") == [(60, 1), (60, 2), (60, 3)]
    df = spark.createDataFrame([("a", 0), ("b", 5), ("c", 23)], "k string, n int")
    want = [(k, n, i) for k, n in (("b", 5), ("c", 23)) for i in range(1, n + 1)]
    for chunk in (1, 4, 5, 100):
        assert rows(explode_to(df, F.col("n"), "i", chunk)) == want
        assert rows(explode_spread(df, F.col("n"), "i", chunk)) == want


def test_subsample_keeps_the_smaller_and_moves_the_rest(survey):
    lfreq, _, _ = survey
    drawn = sampling.subsample(lfreq, 20, 42)
    per_haul = drawn.groupBy(*KH).agg(F.count("id").alias("k"), F.max("n").alias("n"), F.max("new_samp").alias("s"))
    assert per_haul.filter((F.col("k") != F.least("n", F.lit(20))) | (F.col("k") != F.col("s"))).isEmpty()
    moved = sampling.newly_unsexed(lfreq, [Run(20)], 42)
    sexed, _ = sampling.split_sexed(lfreq)
    assert rows(drawn.select("id").unionByName(moved.select("id"))) == rows(sexed, "id")


def test_totals_by_haul_and_length_do_not_change(survey):
    lfreq, _, _ = survey
    keys = [*KH, "length"]
    before = lfreq.groupBy(*keys).agg(F.sum("frequency"))
    assert rows(sampling.retabulate(lfreq, 20, 42).groupBy(*keys).agg(F.sum("frequency"))) == rows(before)


@pytest.mark.parametrize("hot_rows", [0, 60, 150])
def test_hot_hauls_draw_the_same_fish(survey, monkeypatch, hot_rows):
    lfreq, cpue, _ = survey
    runs = [Run(20, 2), Run(40, 3)]
    plain = rows(population.resampled(lfreq, cpue, runs, 1997, seed=7))
    fish = rows(sampling.newly_unsexed(since(lfreq, 1997), runs, 7))
    monkeypatch.setattr(sampling, "CHUNK", 8)
    assert rows(population.resampled(lfreq, cpue, runs, 1997, seed=7, hot_rows=hot_rows)) == plain
    assert rows(sampling.newly_unsexed(since(lfreq, 1997), runs, 7, hot_rows)) == fish


@pytest.mark.parametrize(("digits", "rank_rows", "samples"), [(4, 100_000, 10_000), (1, 1, 20), (2, 3, 7), (1, 1, 0)])
def test_counting_prefixes_finds_the_same_fish(survey, monkeypatch, digits, rank_rows, samples):
    """All hauls pooled into a few large ones, drawn whole and by counts of prefixes, over several rounds."""
    lfreq = survey[0].withColumns({"hauljoin": F.col("year").cast("bigint"), "frequency": F.col("frequency") * 9})
    runs = [Run(samples, 2)]
    cells = sampling.sample_cells(lfreq)
    plain = rows(sampling.retabulate_cells(cells, runs, 5))
    fish = rows(sampling.newly_unsexed(lfreq, runs, 5))
    monkeypatch.setattr(sampling, "CHUNK", 64)
    monkeypatch.setattr(selection, "DIGITS", digits)
    monkeypatch.setattr(selection, "RANK_ROWS", rank_rows)
    assert rows(sampling.retabulate_cells(cells, runs, 5, 0)) == plain
    assert rows(sampling.newly_unsexed(lfreq, runs, 5, 0)) == fish
    draws = sampling.draw_table(cells, runs, 5, 0)
    assert rows(sampling.cells_of_draws(draws)) == plain
    assert rows(sampling.removed_of_draws(draws)) == fish


def test_only_keys_under_the_cut_are_ranked(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANK_ROWS", 50)
    keys = spark.range(200_000).select((F.col("id") % 3).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("_key"))
    group, k = ["g"], F.lit(1000)

    def some(cut):
        return keys if cut is None else keys.join(cut, group)

    cut = selection.cut_prefix(some, group, k)
    # One row in 65,536 prefixes and 66,667 keys a group: a few keys share the last prefix.
    assert keys.join(cut, group).filter(F.col("_key").startswith(F.col("_prefix"))).count() < 50
    got = rows(selection.up_to_cut(some(cut), group, k, ["_key"], ["id"]))
    best = sampling.Window.partitionBy("g").orderBy("_key")
    want = keys.withColumn("r", F.row_number().over(best)).filter("r <= 1000").select("g", "id")
    assert got == rows(want)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_numbers_and_removed_fish_come_from_one_draw(survey):
    lfreq, cpue, _ = survey
    runs = [Run(20, 2), Run(40, 1, label=3)]
    size, fish = population.resampled_with_removed(lfreq, cpue, runs, 1997, seed=9)
    assert "md5" not in plan_of(size) and "md5" not in plan_of(fish)
    assert rows(size) == rows(population.resampled(lfreq, cpue, runs, 1997, seed=9))
    assert rows(fish) == rows(sampling.newly_unsexed(since(lfreq, 1997), runs, 9))


def test_removed_mean_needs_no_draw(survey):
    lfreq = survey[0]
    mean = simulate.removed_mean(lfreq, 20, 1997)
    assert "md5" not in plan_of(mean)
    counted = simulate.removed_summary(simulate.removed(lfreq, 3, 20, 1997), 3)
    assert rows(mean) == rows(counted.select(mean.columns))


def test_both_levels_equal_their_own_runs(survey):
    lfreq, cpue, _ = survey
    for whole, strata, one in (
        (*simulate.simulate_both(lfreq, cpue, 2, 20, 1997), lambda st: simulate.simulate(lfreq, cpue, 2, 20, 1997, st)),
        (*simulate.simulate_both(lfreq, cpue, 1, None, 1997), lambda st: simulate.simulate(lfreq, cpue, 1, None, 1997, st)),
        (*simulate.sweep_both(lfreq, cpue, (20, 40), 2, 1997), lambda st: simulate.sweep(lfreq, cpue, (20, 40), 2, 1997, st)),
    ):
        for got, want in ((whole, one(False)), (strata, one(True))):
            assert got.columns == want.columns and rows(got) == rows(want)


@pytest.mark.parametrize("size", [1, 7])
def test_blocks_of_sums_and_abundances_change_nothing(survey, monkeypatch, size):
    lfreq, cpue, _ = survey
    boot = rows(simulate.pop_est_boot(lfreq, cpue, 20, 1997, False, 2))
    plain = rows(simulate.simulate(lfreq, cpue, 3, 20, 1997))
    monkeypatch.setattr(population, "SUMS_PER_BLOCK", size)
    monkeypatch.setattr(population, "ABUNDANCES_PER_BLOCK", size)
    assert rows(simulate.simulate(lfreq, cpue, 3, 20, 1997)) == plain
    assert rows(simulate.pop_est_boot(lfreq, cpue, 20, 1997, False, 2)) == boot


def test_more_samples_than_fish_is_the_full_estimate(survey):
    lfreq, cpue, _ = survey
    full = rows(population.pop_est(lfreq, cpue, None, 1997)[0])
    assert rows(simulate.simulate(lfreq, cpue, 1, 10_000, 1997).drop("sim")) == full


def test_sweep_equals_single_runs_and_partitions_do_not_matter(spark, survey):
    lfreq, cpue, _ = survey
    both = simulate.sweep(lfreq, cpue, (20, 40), 2, 1997)
    one = simulate.simulate(lfreq.repartition(7), cpue.repartition(3), 2, 40, 1997)
    assert rows(both.filter("ss = 40").drop("ss")) == rows(one)


def test_draws_follow_the_haul(survey):
    """Over many replicates the drawn share of males tends to the haul's."""
    lfreq, _, _ = survey
    fish = sampling.subsample(lfreq, 20, 42, iters=60)
    share = fish.groupBy(*KH).agg(F.avg((F.col("sex") == 1).cast("int")).alias("got"), F.max("n").alias("n"))
    sexed, _ = sampling.split_sexed(lfreq)
    true = sexed.groupBy(*KH).agg(F.avg((F.col("sex") == 1).cast("int")).alias("want"))
    both = share.join(true, KH).filter("n > 20")
    # 1,200 draws per haul: five standard errors are below 0.0722.
    assert both.filter(F.abs(F.col("got") - F.col("want")) > 0.0722).isEmpty()


def test_bootstrap_keeps_rows_and_draws_from_the_stratum_and_haul(survey):
    lfreq = since(survey[0], 1997)
    numbered = numbered_rows(lfreq)
    top = numbered.groupBy("year", "species_code", "stratum").agg(
        F.max("ordinal").alias("m"), F.count_distinct("ordinal").alias("d"), F.count("*").alias("c"), F.max("n").alias("n")
    )
    assert top.filter("m != n OR d != n OR c != n").isEmpty()
    hauls = bootstrap_hauls(lfreq, [Run(None, 2)], 42)
    assert hauls.count() == 2 * lfreq.count()
    assert hauls.select(*KH).distinct().join(lfreq, KH, "left_anti").isEmpty()
    lengths = bootstrap_lengths(hauls, 42)
    assert lengths.count() == hauls.count()
    keys = ["sim", *KH, "length"]
    assert lengths.select(*keys).distinct().join(hauls, keys, "left_anti").isEmpty()


@pytest.mark.parametrize(("bits", "big"), [(13, 50_000), (2, 5), (0, 0)])
def test_one_pass_bootstrap_equals_the_two_draws(survey, monkeypatch, bits, big):
    lfreq = since(survey[0], 1997)
    runs = [Run(20, 2), Run(None, 1, label=4)]
    monkeypatch.setattr(bootstrap, "SALTS", 3)
    two = rows(bootstrap_lengths(bootstrap_hauls(lfreq, runs, 3), 3))
    monkeypatch.setattr(bootstrap, "BLOCK_BITS", bits)
    monkeypatch.setattr(bootstrap, "BIG", big)
    one = bootstrapped_rows(lfreq, runs, 3)
    assert rows(one.select("run", "ss", "sim", *KH, "ordinal", "sex", "length", "frequency")) == two
    if big == 50_000:
        # The haul draw stands once in the plan, and so does the length draw.
        assert plan_of(one).count("md5") == 2


@pytest.mark.parametrize(("large", "takers", "big"), [(1_000_000, 1, 50_000), (20, 50, 50_000), (20, 50, 5), (0, 1, 50_000)])
def test_bootstrap_by_all_roads_is_the_same(survey, monkeypatch, large, takers, big):
    lfreq = since(survey[0], 1997)
    # One row many times over, made where it is and spread.
    lfreq = lfreq.unionByName(lfreq.limit(1).crossJoin(lfreq.sparkSession.range(40)).drop("id"))
    runs = [Run(20, 2), Run(None, 1, label=4)]
    two = rows(bootstrap_lengths(bootstrap_hauls(lfreq, runs, 3), 3))
    for name, value in (("LARGE", large), ("STRATUM_TAKERS", takers), ("BIG", big), ("COPIES", 8)):
        monkeypatch.setattr(bootstrap, name, value)
    one = bootstrapped_rows(lfreq, runs, 3).select("run", "ss", "sim", *KH, "ordinal", "sex", "length", "frequency")
    assert rows(one) == two and len(two) == 3 * lfreq.count()


@pytest.mark.parametrize("iters", [1, 30])
def test_bootstrap_moves_each_row_once_however_many_replicates(survey, monkeypatch, iters):
    lfreq, cpue, _ = survey
    lfreq, cpue, runs, plans = since(lfreq, 1997), since(cpue, 1997), [Run(20, iters)], {}

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return session.stage(df, name)

    monkeypatch.setattr(population, "stage", staged)
    with session.settings(lfreq.sparkSession, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        population.basis(bootstrap.bootstrapped_parts(lfreq, runs), cpue, runs, bootstrap.REPS)
    # Rows, donors and hauls go to their stratum; the replicates are made there, and neither they nor their cells move.
    lines = plans["cells"].split("\n")
    moves = [i for i, line in enumerate(lines) if "Exchange " in line]
    made = [i for i, line in enumerate(lines) if "inline([[0,20,1]" in line]
    assert len(moves) == 3 and len(made) == 1 and made[0] < moves[0]


def test_fish_of_a_bootstrap_are_ranked_by_slices_of_strata(survey, monkeypatch):
    cells, runs = sampling.sample_cells(since(survey[0], 1997)), [Run(5, 2)]
    cols = ["run", "ss", "sim", *KH, "length", "males", "females", "unsexed"]
    want = rows(sampling.retabulate_cells(cells, runs, 42), *cols)
    replicated = session.stage(sampling.with_sims(sampling.with_runs(cells, runs)), "replicated")
    for slices in (1, 8):
        monkeypatch.setattr(sampling, "SLICES", slices)
        out = sampling.retabulate_cells(replicated, runs, 42)
        moves = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in line]
        assert len(moves) == 1 and "stratum" in moves[0] and "hauljoin" not in moves[0]
        assert rows(out, *cols) == want


def test_what_a_staged_table_shuffled_goes_when_it_is_written(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name}

    before = shuffled()
    session.stage(spark.range(10_000).repartition(7, "id"), "spread")
    assert not shuffled() - before


def test_bootstrap_of_nothing(survey):
    lfreq = survey[0].limit(0)
    assert bootstrapped_rows(lfreq, [Run(20, 2)]).count() == 0


def test_save_rules(spark, survey, tmp_path):
    lfreq, cpue, _ = survey
    folder = str(tmp_path)
    with pytest.raises(ValueError):
        simulate.sims(lfreq, cpue, 2, samples=20)
    full = simulate.sims(lfreq, cpue, 1, yrs=1997, save="og", folder=folder)
    assert full.columns == ["sim", "year", "species_code", "length", "males", "females", "unsexed"]
    size = simulate.sims(lfreq, cpue, 2, samples=20, yrs=1997, save="s20", folder=folder)
    simulate.sims(lfreq, cpue, 2, samples=20, yrs=1997, save="t20", folder=folder, removed_summ=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == [
        "og.csv", "s20_removed.csv", "s20_size.csv", "t20_removed_summ.csv", "t20_size.csv",
    ]
    assert rows(size) == rows(simulate.simulate(lfreq, cpue, 2, 20, 1997))
    removed = read_result(spark, folder, "s20_removed", {"sim": "int", "hauljoin": "bigint", "id": "string"})
    summed = read_result(spark, folder, "t20_removed_summ", {"hauljoin": "bigint", "ss_removed": "double"})
    assert removed.count() == round(summed.agg(F.sum("ss_removed")).collect()[0][0] * 2)
