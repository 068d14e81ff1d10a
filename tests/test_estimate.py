"""Hand-made cases for the population estimate, one per rule."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from haulcomp.functions.rules import half_even, rdiv
from haulcomp.operators import estimate
from haulcomp.operators.cells import fill_grid, haul_cells, hauls_without_lengths, length_grid, measured_hauls, since
from haulcomp.plans import population

A, B = 10110, 10120


def sizes(lfreq, cpue, yrs=2000, **kw):
    return rows(population.pop_est(lfreq, cpue, None, yrs, **kw)[0])


def test_division(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (-2.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(rdiv(F.col("a"), F.col("b"))).collect()]
    assert got == [None, float("inf"), float("-inf"), 0.25, None]


def test_ties_round_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (2.4999999999,)], "x double")
    assert [r[0] for r in df.select(half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0, 2.0]


def test_zero_total_is_missing_not_an_error(table):
    lfreq = table("lfreq", [(2001, A, 1, 11, 1, 50, 4)])
    cpue = table("cpue", [(2001, A, 5, 11, 1, 0.0, 10.0)])
    assert haul_cells(cpue).select("abund").collect()[0][0] is None
    assert sizes(lfreq, cpue) == [(2001, A, 50, 0.0, 0.0, 0.0)]


def test_unmeasured_haul_gets_the_stratum_mean_and_zero_catch_counts_in_the_mean(table):
    # Haul 11 is measured (all males at 50), 12 is not, 13 caught nothing.
    lfreq = table("lfreq", [(2001, A, 1, 11, 1, 50, 4)])
    cpue = table(
        "cpue",
        [(2001, A, 5, 11, 1, 2.0, 30.0), (2001, A, 6, 12, 1, 4.0, 30.0), (2001, A, None, 13, 1, 0.0, 30.0)],
    )
    # mean 2, total 6: haul 11 stands for 2/6*60 = 20, haul 12 for 40, haul 13 for nothing.
    assert sizes(lfreq, cpue) == [(2001, A, 50, 60.0, 0.0, 0.0)]


def test_no_donor_stratum_contributes_nothing(table):
    lfreq = table("lfreq", [(2001, A, 1, 11, 1, 50, 4)])
    cpue = table("cpue", [(2001, A, 5, 11, 1, 2.0, 10.0), (2001, A, 6, 21, 2, 4.0, 10.0)])
    assert sizes(lfreq, cpue) == [(2001, A, 50, 20.0, 0.0, 0.0)]


def test_haul_measured_for_another_species_is_not_imputed(table):
    lfreq = table("lfreq", [(2001, A, 1, 11, 1, 50, 4), (2001, B, 1, 12, 2, 60, 1)])
    cpue = table(
        "cpue",
        [(2001, A, 5, 11, 1, 1.0, 10.0), (2001, B, 6, 11, 1, 1.0, 10.0), (2001, B, 7, 12, 1, 1.0, 10.0)],
    )
    assert sizes(lfreq, cpue) == [(2001, A, 50, 10.0, 0.0, 0.0), (2001, B, 60, 0.0, 5.0, 0.0)]


def test_repeated_catch_rows_count_once_each(table):
    lfreq = table("lfreq", [(2001, A, 1, 11, 1, 50, 4)])
    twice = [(2001, A, 5, 11, 1, 2.0, 10.0), (2001, A, 5, 11, 1, 4.0, 10.0)]
    cpue = table("cpue", twice)
    assert estimate.haul_abundance(cpue).count() == 2
    # mean 3, total 6: 3/6*30 = 15, for each of the two rows.
    assert sizes(lfreq, cpue) == [(2001, A, 50, 30.0, 0.0, 0.0)]


def test_repeated_unmeasured_rows_pair_up_and_areas_stay_apart(table):
    lfreq = table("lfreq", [(2001, A, 1, 11, 1, 50, 4)])
    cpue = table(
        "cpue",
        [(2001, A, 5, 11, 1, 2.0, 10.0), (2001, A, 6, 12, 1, 2.0, 10.0), (2001, A, 7, 12, 1, 2.0, 40.0)],
    )
    # mean 2, total 6: 1/3 of 2 * area each, so 20/3 -> 7 (haul 11); haul 12 has two rows x (7 + 27).
    assert sizes(lfreq, cpue) == [(2001, A, 50, 7.0 + 2 * (7.0 + 27.0), 0.0, 0.0)]


def test_only_males_still_gives_three_columns(table):
    lfreq = table("lfreq", [(2001, A, 1, 11, 1, 50, 4)])
    wide = estimate.sexes_wide(lfreq.select("year", "length", "sex", F.col("frequency").alias("abund")))
    assert rows(wide) == [(2001, 50, 4, None, None)]


def test_old_length_is_in_the_grid(table):
    lfreq = table("lfreq", [(1990, A, 1, 10, 1, 70, 1), (2001, A, 1, 11, 1, 50, 4)])
    assert rows(length_grid(lfreq, 2000)) == [(2001, A, 50), (2001, A, 70)]
    assert rows(length_grid(lfreq, None, True)) == [(y, A, 1, n) for y in (1990, 2001) for n in (50, 70)]


def test_missing_frequency_makes_the_haul_and_its_stratum_mean_missing(table):
    lfreq = table("lfreq", [(2001, A, 1, 11, 1, 50, None), (2001, A, 1, 11, 2, 60, 3), (2001, A, 1, 13, 2, 70, 3)])
    cpue = table("cpue", [(2001, A, h, h, 1, 1.0, 12.0) for h in (11, 12, 13)])
    # 12 / 3 per haul. Haul 11 is missing, haul 12 gets only length 70 at half, haul 13 is whole.
    assert sizes(lfreq, cpue) == [(2001, A, 50, 0.0, 0.0, 0.0), (2001, A, 60, 0.0, 0.0, 0.0), (2001, A, 70, 0.0, 6.0, 0.0)]


@pytest.mark.parametrize("by_stratum", [False, True])
@pytest.mark.parametrize("slices", [10_000, 1])
def test_fused_plan_equals_the_steps(survey, monkeypatch, by_stratum, slices):
    """P9 to P17 one by one give what the plan gives, also with every unmeasured haul in its own slice."""
    from haulcomp.operators import cells

    monkeypatch.setattr(cells, "HAULS_PER_SLICE", slices)
    lfreq, cpue, _ = survey
    recent, catches = since(lfreq, 1997), since(cpue, 1997)
    comp = estimate.length_comp(recent)
    no_length = hauls_without_lengths(catches, measured_hauls(recent))
    sized = estimate.expand(
        estimate.impute_comp(no_length, estimate.stratum_comp(comp), comp), estimate.haul_abundance(catches)
    )
    wide = estimate.sexes_wide(estimate.size_sum(sized, by_stratum))
    steps = fill_grid(length_grid(lfreq, 1997, by_stratum), wide)
    assert rows(steps) == sizes(lfreq, cpue, 1997, by_stratum=by_stratum)


def test_invariants(survey):
    lfreq, cpue, _ = survey
    comp = estimate.length_comp(lfreq)
    per_haul = comp.groupBy("year", "species_code", "stratum", "hauljoin").agg(F.sum("comp").alias("s"))
    assert per_haul.filter(F.abs(F.col("s") - 1) > 1e-9).isEmpty()
    per_stratum = estimate.stratum_comp(comp).groupBy("year", "species_code", "stratum").agg(F.sum("comp").alias("s"))
    assert per_stratum.filter(F.abs(F.col("s") - 1) > 1e-9).isEmpty()
    size = population.pop_est(lfreq, cpue, None, 1997)[0]
    assert size.count() == length_grid(lfreq, 1997).count()
    for sex in ("males", "females", "unsexed"):
        assert size.filter((F.col(sex) < 0) | (F.rint(sex) != F.col(sex))).isEmpty()
    strata = population.pop_est(lfreq, cpue, None, 1997, True)[0]
    over = strata.groupBy("year", "species_code", "length").agg(*[F.sum(s).alias(s) for s in ("males", "females", "unsexed")])
    assert rows(over) == rows(size)
