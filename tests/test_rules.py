"""Rules that no query shows: no caps, nothing dropped, staging, headers, missing values, sweep labels."""

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from haulcomp import session
from haulcomp.functions.rules import half_even
from haulcomp.operators import bootstrap, ess, sampling, summary
from haulcomp.operators.cells import since
from haulcomp.operators.sampling import EVERY_FISH, Run
from haulcomp.plans import simulate
from haulcomp.sources import fixtures, results, tables

A = 10110


def test_every_fish_is_no_sample_size(survey):
    cells = sampling.sample_cells(survey[0])
    assert sampling.random_part(cells, [Run(None)]).isEmpty()
    assert sampling.settled_part(cells, [Run(None)]).count() == cells.count()
    assert sampling.random_part(cells, [Run(0)]).count() > 0


def test_views_drop_no_line_item(spark):
    items = fixtures.table(spark, SF, "lineitem")
    orders = fixtures.table(spark, SF, "orders").select(F.floor(F.col("o_totalprice") / 10000) + 1)
    total = items.agg(F.sum("l_quantity")).first()[0] + orders.groupBy().sum().first()[0]
    assert fixtures.cpue(spark, SF).agg(F.sum("numcpue")).first()[0] == total
    assert fixtures.order_catches(spark, SF).count() == orders.count()
    for view in (fixtures.base, fixtures.lfreq, fixtures.specimen):
        assert view(spark, SF).count() == items.count()
    assert not fixtures.cpue(spark, SF).filter("catchjoin IS NULL").isEmpty()


def test_a_hot_haul_draws_the_same_lengths_whatever_the_salts(spark, survey, monkeypatch):
    lfreq = since(survey[0], 1997)
    one = lfreq.first()
    hot = lfreq.limit(3000).withColumns({k: F.lit(one[k]) for k in ("year", "species_code", "stratum", "hauljoin")})
    drawn = bootstrap.bootstrap_hauls(lfreq.unionByName(hot), [Run(20, 2)], 5)
    got = []
    for salts in (1, 5, 16):
        monkeypatch.setattr(bootstrap, "SALTS", salts)
        got.append(rows(bootstrap.bootstrap_lengths(drawn, 5)))
    assert got[0] == got[1] == got[2] and len(got[0]) == drawn.count()


def test_one_job_for_many_bootstraps_equals_single_ones(survey):
    lfreq, cpue, _ = survey
    og = session.stage(simulate.simulate(lfreq, cpue, 1, None, 1997).drop("sim"), "og")
    both = simulate.sweep_boot(lfreq, cpue, og, (None, 20), 1997, boot=2)
    keys = ["sim", "year", "species_code", "ess", "in_out"]
    for n, name in ((None, "base"), (20, "s020")):
        alone = simulate.sims_boot(lfreq, cpue, og, n, 1997, boot=2)
        assert rows(both.filter(F.col("type") == name), *keys) == rows(alone, *keys)
    assert {r.ss for r in both.select("ss").distinct().collect()} == {0, 20}
    assert EVERY_FISH < 0


def test_a_sweep_keeps_its_sizes_apart(spark):
    size = "ss int, sim int, year int, species_code int, length int, males double, females double, unsexed double"
    sweep = spark.createDataFrame([(20, 1, 2001, A, 50, 0.0, 1.0, 1.0), (40, 1, 2001, A, 50, 100.0, 1.0, 1.0)], size)
    means = summary.bin_summary(sweep, "x").filter("name = 'males'")
    assert rows(means, "ss", "mean") == [(20, 0.0), (40, 100.0)]
    base = sweep.filter("ss = 20").drop("ss", "sim")
    table = summary.compare(base, sweep).filter("name = 'males'")
    assert rows(table, "ss", "base", "sim") == [(20, 0.0, 0.0), (40, 0.0, 100.0)]


def test_half_even_is_half_only_at_a_half(spark):
    x = spark.createDataFrame([(1.4999997,), (1.5,), (2.5,), (2.5 - 1e-15,), (1e9 + 0.5,), (-1.5,)], "x double")
    assert [r[0] for r in x.select(half_even(F.col("x"))).collect()] == [1.0, 2.0, 2.0, 2.0, 1e9, -2.0]


def test_missing_length_and_frequency_stop_the_job(spark, table):
    strata = spark.createDataFrame([(1, 2.0)], "stratum int, area double")
    raw = spark.createDataFrame([("AI", 2001, A, 1, 11, 1, None, 3)], "SURVEY string, YEAR int, SPECIES_CODE int, STRATUM int, HAULJOIN bigint, SEX int, LENGTH int, FREQUENCY int")
    with pytest.raises(Exception, match="length is missing"):
        tables.lfreq_from(raw, "AI", strata).collect()
    with pytest.raises(Exception, match="frequency is missing"):
        sampling.uncount(table("lfreq", [(2001, A, 1, 11, 1, 50, None)])).collect()


def test_readers_and_headers(spark, tmp_path):
    strata = spark.createDataFrame([(1, 2.0)], "stratum int, area double")
    lf = tmp_path / "lf"
    lf.mkdir()
    head = "SURVEY,YEAR,SPECIES_CODE,STRATUM,HAULJOIN,SEX,LENGTH,FREQUENCY\n"
    (lf / "a.csv").write_text(head + "AI,2001,10110,1,11,1,50,3\nAI,2001,10110,9,11,1,50,3\nGOA,2001,10110,1,11,1,50,3\n")
    (lf / "b.csv").write_text(head + "AI,2002,10110,1,12,2,60,4\n")
    assert rows(tables.read_lfreq(spark, str(lf), "AI", strata)) == [(2001, A, 1, 11, 1, 50, 3), (2002, A, 1, 12, 2, 60, 4)]
    (lf / "c.csv").write_text("SURVEY,YEAR,SPECIES_CODE,HAULJOIN,STRATUM,SEX,LENGTH,FREQUENCY\nAI,2002,10110,12,1,2,60,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_lfreq(spark, str(lf), "AI", strata).collect()
    sp = tmp_path / "sp.csv"
    sp.write_text("REGION,YEAR,SPECIES_CODE,STRATUM,HAULJOIN,SEX,LENGTH,AGE\nAI,2001,10110,1,11,1,50,3\nAI,2001,10110,1,11,1,50,NA\n")
    assert rows(tables.read_specimen(spark, str(sp), "AI", strata)) == [(2001, A, 1, 11, 1, 50, 3)]
    pop = tmp_path / "pop.csv"
    pop.write_text("SURVEY,YEAR,LENGTH\nAI,2001,50\nGOA,2001,50\n")
    assert rows(tables.read_sizepop(spark, str(pop), "AI")) == [("2001", "50")]


def test_scores_are_saved(spark, tmp_path):
    size = "year int, species_code int, length int, males double, females double, unsexed double"
    og = spark.createDataFrame([(2001, A, 50, 1.0, 2.0, 0.0), (2001, A, 60, 3.0, 4.0, 1.0)], size)
    sim = spark.createDataFrame([(2001, A, 50, 2.0, 2.0, 0.0), (2001, A, 60, 3.0, 5.0, 1.0)], size).withColumn("sim", F.lit(1))
    scores = ess.ess_size(sim, og)
    assert rows(results.saved(scores, str(tmp_path), "ess")) == rows(scores)


def test_staged_tables_go_with_their_context(spark):
    with session.staging(spark):
        kept = session.stage(spark.range(3), "short")
        assert kept.count() == 3
    with pytest.raises(Exception):
        session.stage(kept, "again")


def test_off_a_local_master_the_shared_folder_must_be_named():
    class Context:
        master = "yarn"

    class Unset:
        def get(self, key, default=None):
            return default

    class Other:
        conf = Unset()
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Other())


@pytest.mark.parametrize(
    ("kind", "head", "good", "bad"),
    [
        ("strata", "SURVEY,STRATUM,AREA", ["AI,1,10.5", "AI,2,NA"], [("AI,x1,10", "stratum: x1"), ("AI,3,ten", "area: ten")]),
        (
            "lfreq",
            "SURVEY,YEAR,SPECIES_CODE,STRATUM,HAULJOIN,SEX,LENGTH,FREQUENCY",
            ["AI,2001,10110,1,11,1,50,3"],
            [("AI,2001,10110,1,11,1,5O,3", "length: 5O"), ("AI,2001,10110,1,11,1,NA,3", "length: missing"), ("AI,2001,10110,1,11,1,50,1.5", "frequency: 1.5"),
             ("AI,20x1,10110,1,11,?,50,3", "year: 20x1; sex: ?")],
        ),
        (
            "cpue",
            "SURVEY,YEAR,SPECIES_CODE,CATCHJOIN,HAULJOIN,STRATUM,NUMCPUE",
            ["AI,2001,10110,NA,11,1,1.5"],
            [("AI,2001,10110,7,99999999999999999999,1,1.5", "hauljoin: 99999999999999999999")],
        ),
        (
            "specimen",
            "REGION,YEAR,SPECIES_CODE,STRATUM,HAULJOIN,SEX,LENGTH,AGE",
            ["AI,2001,10110,1,11,1,50,3"],
            [("AI,2001,10110,1,11,1,50,three", "age: three")],
        ),
    ],
)
def test_malformed_fields_are_returned_with_file_and_reason(spark, tmp_path, kind, head, good, bad):
    folder = tmp_path / kind
    folder.mkdir()
    other = [x[0].replace("AI,", "GOA,") for x in bad]
    (folder / "a.csv").write_text("\n".join([head, *good, *other]) + "\n")
    (folder / "b.csv").write_text("\n".join([head, *[x[0] for x in bad], "AI,2001", good[0] + ",too,many", "GOA,1"]) + "\n")
    strata = spark.createDataFrame([(1, 10.0)], "stratum int, area double")
    rows_, rejects = tables.read_checked(spark, kind, str(folder), "AI", None if kind == "strata" else strata)
    read = {"strata": tables.read_strata, "lfreq": tables.read_lfreq, "cpue": tables.read_cpue, "specimen": tables.read_specimen}[kind]
    clean = tmp_path / "clean.csv"
    clean.write_text("\n".join([head, *good]) + "\n")
    want = read(spark, str(clean), "AI", *([] if kind == "strata" else [strata]))
    assert rows_.dtypes == want.dtypes and rows(rows_) == rows(want)
    got = [("; ".join(r.reasons), r._corrupt, r._file.rpartition("/")[2]) for r in rejects.collect()]
    broken = "line: not as many fields as the header"
    whole = [(x[1], None, "b.csv") for x in bad]
    assert sorted(got, key=str) == sorted(whole + [(broken, t, "b.csv") for t in ("AI,2001", good[0] + ",too,many", "GOA,1")], key=str)
    if bad[0][1] != "stratum: x1":
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|CAST_OVERFLOW|is missing|header"):
            read(spark, str(folder), "AI", strata).collect()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_a_result_is_replaced_as_a_whole(spark, tmp_path, monkeypatch, fmt):
    folder, schema = str(tmp_path), {"id": "bigint"}

    def read():
        return [r[0] for r in rows(results.read_result(spark, folder, "r", schema, fmt))]

    results.write_result(spark.range(3), folder, "r", fmt)
    assert read() == [0, 1, 2]
    before = results.read_result(spark, folder, "r", schema, fmt)

    def lost(*_):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(results, "_publish", lost)
        with pytest.raises(RuntimeError):
            results.write_result(spark.range(5), folder, "r", fmt)
    assert read() == [0, 1, 2]
    with pytest.raises(Exception, match="broken row"):
        broken = F.when(F.col("id") == 3, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("bigint").alias("id")
        results.write_result(spark.range(9).select(broken), folder, "r", fmt)
    assert read() == [0, 1, 2]
    results.write_result(spark.range(4), folder, "r", fmt)
    assert read() == [0, 1, 2, 3]
    # A reader of the version before is not disturbed; what failed is gone, and what is older still goes with the next.
    assert [r[0] for r in rows(before)] == [0, 1, 2]
    assert len(results.versions(spark, folder, "r", fmt)) == 2
    results.write_result(results.read_result(spark, folder, "r", schema, fmt).filter("id > 1"), folder, "r", fmt)
    assert read() == [2, 3]
    assert len([p for p in (tmp_path / f"r.{fmt}").iterdir() if p.name.startswith("v")]) == 2


def test_a_folder_without_a_log_is_a_result(spark, tmp_path):
    spark.range(3).write.option("header", True).csv(str(tmp_path / "old.csv"))
    assert results.read_result(spark, str(tmp_path), "old", {"id": "bigint"}).count() == 3
