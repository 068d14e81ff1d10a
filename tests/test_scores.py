"""Effective sample size, sex ratio, ages, summaries and sources on hand-made tables."""

import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from haulcomp.operators import age, ess, summary
from haulcomp.operators.distribution import density, quantiles, rank_index
from haulcomp.sources import tables

A = 10110
SIZE = "year int, species_code int, length int, males double, females double, unsexed double"


def test_equal_tables_are_out(spark):
    og = spark.createDataFrame([(2001, A, 50, 1.0, 2.0, 0.0), (2001, A, 60, 3.0, 4.0, 1.0)], SIZE)
    got = ess.ess_size(og.withColumn("sim", F.lit(1)), og)
    assert {(r.value, r.in_out) for r in got.collect()} == {(float("inf"), "out")}


def test_one_bin_and_no_males_drop_the_group(spark):
    one_bin = spark.createDataFrame([(2001, A, 50, 5.0, 2.0, 0.0), (2001, A, 60, 0.0, 4.0, 1.0)], SIZE)
    assert ess.ess_size(one_bin.withColumn("sim", F.lit(1)), one_bin).count() == 0
    no_males = spark.createDataFrame([(2001, A, 50, 0.0, 2.0, 0.0), (2001, A, 60, 0.0, 4.0, 1.0)], SIZE)
    sim = no_males.withColumn("sim", F.lit(1))
    assert ess.ess_size(sim, no_males).count() == 0
    assert rows(ess.prop_fm(sim, no_males)) == [(1, 2001, A, float("inf"), float("inf"))]


def test_strata_guards(spark):
    flat = spark.createDataFrame([(1, 2001, A, 50, 1.0, 2.0, 0.0)], "sim int, " + SIZE)
    deep = flat.withColumn("stratum", F.lit(1))
    for call in (
        lambda: ess.ess_size(deep, deep),
        lambda: ess.prop_fm(flat, deep),
        lambda: summary.compare(flat, deep, True),
        lambda: summary.ribbon_frame(deep, deep),
    ):
        with pytest.raises(ValueError):
            call()


def test_missing_length_and_unsexed_years(spark, table):
    spec = table(
        "specimen",
        [(2001, A, 1, 11, 1, 50, 3), (2001, A, 1, 11, 1, 90, 3), (2001, A, 1, 11, 2, 50, 4), (2001, A, 1, 11, 3, 50, 4)]
        + [(2002, A, 1, 12, 1, 50, 3)],
    )
    size = spark.createDataFrame([(2001, A, 50, 6.0, 8.0, 9.0), (2002, A, 50, 6.0, 8.0, 9.0)], SIZE)
    cols = ["year", "age", "unsexed", "males", "females"]
    # Length 90 is not in the size table: age 3 is missing for males and unsexed of 2001.
    assert age.age_pop_est(spec, size, 2000).orderBy("year", "age").select(*cols).collect() == [
        (2001, 3, None, None, 0.0), (2001, 4, 6.0, 0.0, 8.0), (2002, 3, 0.0, 6.0, 0.0),
    ]
    sim = age.age_pop_est(spec, size.withColumn("sim", F.lit(1)), 2000, sim=True)
    assert rows(sim, *cols) == [(2001, 3, 3.0, 6.0, 0.0), (2001, 4, 6.0, 0.0, 8.0), (2002, 3, 0.0, 6.0, 0.0)]


def test_ages_add_up_to_lengths(survey):
    key = age.age_length_key(survey[2])
    sums = key.groupBy("year", "species_code", "sex", "length").agg(F.sum("age_frac").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_are_exact(spark, n):
    rng = random.Random(n)
    data = [("hot", round(rng.gauss(0, 1), 2)) for _ in range(n)] + [("same", 3.0)] * 5
    got = {r.k: r for r in quantiles(spark.createDataFrame(data, "k string, x double"), ["k"], "x", {"a": 0.25, "b": 0.9}).collect()}
    xs = sorted(x for k, x in data if k == "hot")

    def want(p):
        at = (n - 1) * p
        lo = int(at)
        return xs[lo] + (xs[min(lo + 1, n - 1)] - xs[lo]) * (at - lo)

    assert got["hot"].a == pytest.approx(want(0.25)) and got["hot"].b == pytest.approx(want(0.9))
    assert (got["same"].a, got["same"].n) == (3.0, 5)


def test_rank_index_spreads_a_large_group(spark):
    """One group with a third of the values has about a third of the parts, and ranks run on over them."""
    import numpy as np

    rng = np.random.default_rng(0)
    values = [("hot", float(v)) for v in rng.normal(size=3000)] + [(f"g{i % 200}", float(v)) for i, v in enumerate(rng.normal(size=6000))]
    df = spark.createDataFrame(values + [(None, 1.0), (None, 2.0), ("hot", None)], "k string, x double")
    ranks = rank_index(df, ["k"], "x")
    got = {(r.k, r.x): (r.copies, r.below, r.n) for r in ranks.collect()}
    for k in ("hot", "g7"):
        xs = sorted(v for g, v in values if g == k)
        assert all(got[k, x] == (1, i, len(xs)) for i, x in enumerate(xs))
    assert got[None, 2.0] == (1, 1, 2)
    parts = df.filter("x IS NOT NULL").repartitionByRange(12, "k", "x").withColumn("p", F.spark_partition_id())
    assert parts.filter("k = 'hot'").select("p").distinct().count() >= 3


def test_density_by_reach_equals_the_whole_sum(spark):
    """Values far from each other: most points are out of reach of most values, and the sums are the same."""
    import numpy as np

    xs = np.concatenate([np.linspace(0, 1, 40), np.linspace(0.2, 0.3, 400), [60.0, 1000.0]])
    df = spark.createDataFrame([("a", float(x)) for x in xs], "k string, x double")
    got = density(df, ["k"], "x", 300).orderBy("point").toPandas()
    n = len(xs)
    iqr = np.subtract(*np.percentile(xs, [75, 25]))
    bw = 0.9 * min(xs.std(ddof=1), iqr / 1.34) * n**-0.2
    at = np.linspace(0, 1000, 300)
    want = np.exp(-0.5 * ((at[:, None] - xs) / bw) ** 2).sum(axis=1) / (n * bw * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got.density, want, rtol=1e-9, atol=0)
    assert (got.density == 0).sum() > 200


def test_point_range_floor_and_single_value(spark):
    data = [(A, "ess_m", "base", 0, 1.0), (A, "ess_m", "base", 0, 1.5), (A, "ess_f", "base", 0, 4.0), (A, "ess_t", "base", 0, 4.0)]
    df = spark.createDataFrame(data, "species_code int, ess string, type string, ss int, value double")
    got = {r.ess: r for r in summary.point_range(df).collect()}
    assert set(got) == {"ess_m", "ess_f"}
    assert got["ess_m"].mean == pytest.approx(0.8) and got["ess_m"].lci == 0.0
    assert got["ess_m"].se == pytest.approx(1 / statistics.stdev([1.0, 1.5]) / 2**0.5)
    assert (got["ess_f"].mean, got["ess_f"].se, got["ess_f"].lci) == (0.25, None, None)


def test_density_integrates_to_one(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("a", rng.gauss(0, 1)) for _ in range(200)] + [("b", 1.0)], "k string, x double")
    curve = density(df, ["k"], "x", 128, []).toPandas().sort_values("point")
    assert set(curve.k) == {"a"}
    width = curve.x.iloc[1] - curve.x.iloc[0]
    assert 0.97 < curve.density.sum() * width < 1.01


def test_csv_by_name_with_missing_values(spark, tmp_path):
    (tmp_path / "CPUE.csv").write_text(
        "NUMCPUE,SURVEY,YEAR,SPECIES_CODE,CATCHJOIN,HAULJOIN,STRATUM,EXTRA\n"
        "1.5,AI,2001,10110,NA,11,1,x\n2,AI,2001,10110,7,12,9,y\n3,GOA,2001,10110,8,13,1,z\n"
    )
    (tmp_path / "strata.csv").write_text("SURVEY,STRATUM,AREA\nAI,1,10\nGOA,1,20\n")
    strata = tables.read_strata(spark, str(tmp_path / "strata.csv"), "AI")
    cpue = tables.read_cpue(spark, str(tmp_path / "CPUE.csv"), "AI", strata)
    got = cpue.orderBy("hauljoin").collect()
    assert [tuple(r) for r in got] == [(2001, A, None, 11, 1, 1.5, 10.0), (2001, A, 7, 12, 9, 2.0, None)]
    with pytest.raises(ValueError):
        tables.typed(strata, {"nowhere": "int"})
