"""Every operator as a query on the test tables: name -> (spark, sf_dir) -> DataFrame.

All of them run over the whole tables seen through ``sources.fixtures``. ``oracle.sql`` has
the same names as plain SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcomp.functions.rules import KH
from haulcomp.operators import age, distribution, estimate, ess, sampling, summary
from haulcomp.operators.bootstrap import bootstrap_hauls, bootstrap_lengths, bootstrapped_rows
from haulcomp.operators.cells import (
    fill_grid,
    hauls_without_lengths,
    length_grid,
    measured_hauls,
    since,
)
from haulcomp.operators.sampling import Run
from haulcomp.plans import population, simulate
from haulcomp.session import shared_dir, stage, staged_once
from haulcomp.sources import fixtures, results, schemas, tables

# Settings the SQL repeats.
YRS = 1997
SEED = 42
SAMPLES = 20
SIMS = 3
SWEEP = (20, 40)
ITERS = (2, 3)
ITERS_SAMPLES = 40
POINTS = 64
SURVEY = "GOA"
# The species the effective-sample-size charts show.
CHART_SPECIES = (21921, 10110, 21720)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Float columns to a number of places, for comparing by value; infinities pass."""
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def single(df: DataFrame, col: str) -> DataFrame:
    """A float column to single precision, for values of any size whose last digits hang on summation order."""
    return df.withColumn(col, F.col(col).cast("float").cast("double"))


def survey_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table seen as a survey table, derived once per application."""

    def build() -> DataFrame:
        items = staged_once(spark, f"items {sf}", lambda: fixtures.base(spark, sf))
        return getattr(fixtures, name)(spark, sf, items)

    return staged_once(spark, f"{name} {sf}", build)


def lfreq(spark: SparkSession, sf: str) -> DataFrame:
    return survey_table(spark, sf, "lfreq").drop("survey")


def cpue(spark: SparkSession, sf: str) -> DataFrame:
    return survey_table(spark, sf, "cpue").drop("survey")


def specimen(spark: SparkSession, sf: str) -> DataFrame:
    return survey_table(spark, sf, "specimen").drop("region").filter(F.col("age").isNotNull())


def recent(df: DataFrame) -> DataFrame:
    return since(df, YRS)


def raw(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def estimated(spark: SparkSession, sf: str, by_stratum: bool = False) -> DataFrame:
    return population.pop_est(lfreq(spark, sf), cpue(spark, sf), None, YRS, by_stratum)[0]


def simulated(spark: SparkSession, sf: str, by_stratum: bool = False) -> DataFrame:
    return simulate.simulate(lfreq(spark, sf), cpue(spark, sf), SIMS, SAMPLES, YRS, by_stratum, SEED)


def base(spark: SparkSession, sf: str, by_stratum: bool = False) -> DataFrame:
    """The base estimate as the evaluation finds it: written by an earlier step."""
    return staged_once(spark, f"og {by_stratum} {sf}", lambda: estimated(spark, sf, by_stratum))


def sampled(spark: SparkSession, sf: str, by_stratum: bool = False) -> DataFrame:
    """The replicates as the evaluation finds them: written by an earlier step."""
    return staged_once(spark, f"sims {by_stratum} {sf}", lambda: simulated(spark, sf, by_stratum))


# ---- sources and sinks ---------------------------------------------------------------------


def _strata(spark: SparkSession, sf: str) -> DataFrame:
    return tables.strata_from(raw(fixtures.strata(spark, sf)), SURVEY)


@query
def s1_read_strata(spark: SparkSession, sf: str) -> DataFrame:
    return _strata(spark, sf)


@query
def s2_read_lfreq(spark: SparkSession, sf: str) -> DataFrame:
    return tables.lfreq_from(raw(survey_table(spark, sf, "lfreq")), SURVEY, _strata(spark, sf))


def _mistyped(spark: SparkSession, sf: str) -> DataFrame:
    """Length rows as text, with a letter for a digit in lengths of one decimetre and words for some counts of the unsexed."""
    text = raw(survey_table(spark, sf, "lfreq")).select("SURVEY", *[F.col(c.upper()).cast("string").alias(c.upper()) for c in schemas.LFREQ])
    length = F.when(F.col("LENGTH") == "100", F.lit("1OO")).otherwise(F.col("LENGTH"))
    several = F.when((F.col("SEX") == "3") & (F.col("FREQUENCY") == "5"), F.lit("several"))
    return text.withColumns({"LENGTH": length, "FREQUENCY": several.when(F.col("SEX") != "3", F.col("FREQUENCY")).otherwise(F.lit("NA"))})


@query
def s2_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose fields do not fit, with the reasons."""
    rejects = tables.split_rejects(_mistyped(spark, sf), schemas.LFREQ, ("length", "frequency"))[1]
    return tables.lower_names(rejects).withColumn("reasons", F.array_join("reasons", "; "))


@query
def s2_checked(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that fit, of all surveys, with their types."""
    good = tables.split_rejects(_mistyped(spark, sf), schemas.LFREQ, ("length", "frequency"))[0]
    return tables.typed(tables.lower_names(good), schemas.LFREQ)


@query
def s3_read_cpue(spark: SparkSession, sf: str) -> DataFrame:
    return tables.cpue_from(raw(survey_table(spark, sf, "cpue").drop("area")), SURVEY, _strata(spark, sf))


@query
def s4_read_sizepop(spark: SparkSession, sf: str) -> DataFrame:
    sizes = survey_table(spark, sf, "lfreq").groupBy("survey", "year", "species_code", "length")
    return tables.sizepop_from(raw(sizes.agg(F.sum("frequency").alias("population"))), SURVEY)


@query
def s5_read_specimen(spark: SparkSession, sf: str) -> DataFrame:
    return tables.specimen_from(raw(survey_table(spark, sf, "specimen")), SURVEY, _strata(spark, sf))


@query
def s6_normalise_ebs(spark: SparkSession, sf: str) -> DataFrame:
    length = lfreq(spark, sf).withColumn("cruise", F.col("year") * 100 + 1).drop("year", "stratum")
    haul = cpue(spark, sf).select("hauljoin", "stratum").distinct()
    return tables.normalise_ebs(raw(length), raw(haul))


@query
def s7_normalise_ebs_cpue(spark: SparkSession, sf: str) -> DataFrame:
    hauls = raw(cpue(spark, sf)).withColumnsRenamed({"NUMCPUE": "nCPUE", "AREA": "EFFORT"})
    return tables.normalise_ebs_cpue(hauls)


def _round_trip(df: DataFrame, name: str, schema: dict[str, str], partition_by: list[str] | None = None) -> DataFrame:
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    results.write_result(df, folder, name, "csv", partition_by)
    return results.read_result(spark, folder, name, schema)


@query
def s8_write_result(spark: SparkSession, sf: str) -> DataFrame:
    og = simulate.simulate(lfreq(spark, sf), cpue(spark, sf), 1, None, YRS)
    return _round_trip(og, "og", schemas.SIZE_RESULT)


@query
def s9_read_result(spark: SparkSession, sf: str) -> DataFrame:
    og = simulate.simulate(lfreq(spark, sf), cpue(spark, sf), 1, None, YRS, True)
    return _round_trip(og, "og_st", schemas.SIZE_RESULT_STRATA, ["species_code"])


# ---- population estimate -------------------------------------------------------------------


@query
def p1_length_grid(spark: SparkSession, sf: str) -> DataFrame:
    return length_grid(lfreq(spark, sf), YRS)


@query
def p1_length_grid_strata(spark: SparkSession, sf: str) -> DataFrame:
    return length_grid(lfreq(spark, sf), YRS, True)


@query
def p2_since(spark: SparkSession, sf: str) -> DataFrame:
    return recent(lfreq(spark, sf))


@query
def p3_uncount(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.uncount(lfreq(spark, sf))


@query
def p4_split_sexed(spark: SparkSession, sf: str) -> DataFrame:
    sexed, unsexed = sampling.split_sexed(lfreq(spark, sf))
    return sexed.unionByName(unsexed)


@query
def p5_subsample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.subsample(lfreq(spark, sf), SAMPLES, SEED)


@query
def p6_newly_unsexed(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.newly_unsexed(lfreq(spark, sf), [Run(SAMPLES)], SEED).drop("run", "ss")


@query
def p7_retabulate(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.retabulate(lfreq(spark, sf), SAMPLES, SEED)


@query
def p8_haul_count(spark: SparkSession, sf: str) -> DataFrame:
    return estimate.haul_count(lfreq(spark, sf))


@query
def p9_length_comp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(estimate.length_comp(lfreq(spark, sf)), "comp")


@query
def p10_stratum_comp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(estimate.stratum_comp(estimate.length_comp(lfreq(spark, sf))), "comp")


def _no_length(spark: SparkSession, sf: str) -> DataFrame:
    return hauls_without_lengths(cpue(spark, sf), measured_hauls(lfreq(spark, sf)))


@query
def p11_hauls_without_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return _no_length(spark, sf).select(*KH, "catchjoin", "numcpue", "area")


@query
def p12_haul_abundance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(estimate.haul_abundance(cpue(spark, sf)), "abund")


@query
def p13_abundance_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Catch rows of unmeasured hauls by stratum and abundance, over all years."""
    b = population.basis(lfreq(spark, sf), cpue(spark, sf))
    hist = rounded(population.abundance_histogram(b.unmeasured).withColumnRenamed("_abund", "abund"), "abund")
    return hist.groupBy("year", "species_code", "stratum", "abund").agg(F.sum("_rows").alias("catch_rows"))


def _imputed(spark: SparkSession, sf: str) -> DataFrame:
    comp = stage(estimate.length_comp(lfreq(spark, sf)), "comp")
    return estimate.impute_comp(_no_length(spark, sf), estimate.stratum_comp(comp), comp)


@query
def p13_impute_comp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_imputed(spark, sf), "comp")


def _expanded(spark: SparkSession, sf: str) -> DataFrame:
    return estimate.expand(_imputed(spark, sf), estimate.haul_abundance(cpue(spark, sf)))


@query
def p14_expand(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_expanded(spark, sf), "comp", "abund")


@query
def p15_size_sum(spark: SparkSession, sf: str) -> DataFrame:
    return estimate.size_sum(_expanded(spark, sf))


@query
def p15_size_sum_strata(spark: SparkSession, sf: str) -> DataFrame:
    return estimate.size_sum(_expanded(spark, sf), True)


@query
def p16_sexes_wide(spark: SparkSession, sf: str) -> DataFrame:
    return estimate.sexes_wide(estimate.size_sum(_expanded(spark, sf)))


@query
def p17_fill_grid(spark: SparkSession, sf: str) -> DataFrame:
    wide = estimate.sexes_wide(estimate.size_sum(_expanded(spark, sf), True))
    return fill_grid(length_grid(lfreq(spark, sf), None, True), wide)


@query
def p18_pop_est(spark: SparkSession, sf: str) -> DataFrame:
    return estimated(spark, sf)


@query
def p18_pop_est_strata(spark: SparkSession, sf: str) -> DataFrame:
    return estimated(spark, sf, True)


@query
def p18_pop_est_sampled(spark: SparkSession, sf: str) -> DataFrame:
    return population.pop_est(lfreq(spark, sf), cpue(spark, sf), SAMPLES, YRS, False, SEED)[0]


@query
def p18_pop_est_sampled_strata(spark: SparkSession, sf: str) -> DataFrame:
    return population.pop_est(lfreq(spark, sf), cpue(spark, sf), SAMPLES, YRS, True, SEED)[0]


# ---- simulation and bootstrap --------------------------------------------------------------


@query
def c1_simulate(spark: SparkSession, sf: str) -> DataFrame:
    return simulated(spark, sf)


@query
def c1_simulate_strata(spark: SparkSession, sf: str) -> DataFrame:
    return simulated(spark, sf, True)


def _both(whole: DataFrame, strata: DataFrame) -> DataFrame:
    """Both levels in one table; the whole survey has no stratum."""
    return strata.unionByName(whole, allowMissingColumns=True)


@query
def c1_simulate_both(spark: SparkSession, sf: str) -> DataFrame:
    return _both(*simulate.simulate_both(lfreq(spark, sf), cpue(spark, sf), SIMS, SAMPLES, YRS, SEED))


@query
def c2_removed(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.removed(lfreq(spark, sf), SIMS, SAMPLES, YRS, SEED)


@query
def c3_removed_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(simulate.removed_mean(lfreq(spark, sf), SAMPLES, YRS), "ss_removed")


@query
def c3_removed_counted(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the removed fish themselves, as for a table of them that another program wrote."""
    fish = simulate.removed(lfreq(spark, sf), SIMS, SAMPLES, YRS, SEED)
    return rounded(simulate.removed_summary(fish, SIMS), "ss_removed")


@query
def c4_sims_saved(spark: SparkSession, sf: str) -> DataFrame:
    """The count of removed fish as another program finds it: written by ``sims``, read from its file."""
    folder = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    simulate.sims(lfreq(spark, sf), cpue(spark, sf), SIMS, SAMPLES, YRS, False, "s20", True, folder, SEED)
    schema = {**{k: schemas.LFREQ[k] for k in KH}, "ss_removed": "double"}
    return rounded(results.read_result(spark, folder, "s20_removed_summ", schema), "ss_removed")


def _one_draw(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return population.resampled_with_removed(lfreq(spark, sf), cpue(spark, sf), [Run(SAMPLES, SIMS)], YRS, False, SEED)


@query
def c4_one_draw_size(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers at length from the staged draw that the removed fish come from too."""
    return _one_draw(spark, sf)[0].drop("run", "ss")


@query
def c4_one_draw_removed(spark: SparkSession, sf: str) -> DataFrame:
    return _one_draw(spark, sf)[1].drop("run", "ss")


@query
def c5_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.sweep(lfreq(spark, sf), cpue(spark, sf), SWEEP, SIMS, YRS, False, SEED)


@query
def c5_sweep_both(spark: SparkSession, sf: str) -> DataFrame:
    return _both(*simulate.sweep_both(lfreq(spark, sf), cpue(spark, sf), SWEEP, SIMS, YRS, SEED))


@query
def c6_sweep_iters(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.sweep_iters(lfreq(spark, sf), cpue(spark, sf), ITERS, ITERS_SAMPLES, YRS, False, SEED)


def _boot_rows(spark: SparkSession, sf: str) -> DataFrame:
    return bootstrap_hauls(recent(lfreq(spark, sf)), [Run(SAMPLES, SIMS)], SEED)


@query
def c7a_bootstrap_hauls(spark: SparkSession, sf: str) -> DataFrame:
    return _boot_rows(spark, sf).drop("run", "ss")


@query
def c7b_bootstrap_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return bootstrap_lengths(_boot_rows(spark, sf), SEED).drop("run", "ss")


@query
def c7_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Both draws in one pass."""
    return bootstrapped_rows(recent(lfreq(spark, sf)), [Run(SAMPLES, SIMS)], SEED).drop("run", "ss")


@query
def c8_pop_est_boot(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.pop_est_boot(lfreq(spark, sf), cpue(spark, sf), SAMPLES, YRS, False, SIMS, SEED)


def _boot_ess(spark: SparkSession, sf: str, samples: int | None) -> DataFrame:
    og = base(spark, sf)
    return simulate.sims_boot(lfreq(spark, sf), cpue(spark, sf), og, samples, YRS, False, SIMS, SEED)


@query
def c9_sims_boot(spark: SparkSession, sf: str) -> DataFrame:
    return single(_boot_ess(spark, sf, SAMPLES), "value")


def _scenarios(spark: SparkSession, sf: str) -> DataFrame:
    og = base(spark, sf)
    return simulate.sweep_boot(lfreq(spark, sf), cpue(spark, sf), og, (None, *SWEEP), YRS, False, SIMS, SEED)


@query
def c10_label_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """The first scenario on its own under the others of one job: labels by hand or by the sweep are the same."""
    rest = _scenarios(spark, sf).filter(F.col("type") != "base")
    first = simulate.label_scenarios({"base": (0, _boot_ess(spark, sf, None))})
    return single(rest.unionByName(first), "value")


# ---- summaries -----------------------------------------------------------------------------


@query
def d1_sexes_long(spark: SparkSession, sf: str) -> DataFrame:
    return summary.sexes_long(base(spark, sf))


@query
def d2_bin_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.bin_summary(sampled(spark, sf), "s20"), "mean", "se", "lci", "uci", places=4)


@query
def d2_bin_summary_strata(spark: SparkSession, sf: str) -> DataFrame:
    df = summary.bin_summary(sampled(spark, sf, True), "s20_st", True)
    return rounded(df, "mean", "se", "lci", "uci", places=4)


def _swept(spark: SparkSession, sf: str) -> DataFrame:
    return staged_once(
        spark, f"sweep {sf}", lambda: simulate.sweep(lfreq(spark, sf), cpue(spark, sf), SWEEP, SIMS, YRS, False, SEED)
    )


@query
def d2_bin_summary_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.bin_summary(_swept(spark, sf), "sweep"), "mean", "se", "lci", "uci", places=4)


@query
def d4_compare_sweep(spark: SparkSession, sf: str) -> DataFrame:
    df = summary.compare(base(spark, sf), _swept(spark, sf), False, "og", "s20")
    return rounded(df, "og", "s20", "diff", "pd", places=4)


@query
def d3_only(spark: SparkSession, sf: str) -> DataFrame:
    return summary.only(base(spark, sf), ["10110", "10120"], [1998, 1999])


@query
def d4_compare(spark: SparkSession, sf: str) -> DataFrame:
    df = summary.compare(base(spark, sf), sampled(spark, sf), False, "og", "s20")
    return rounded(df, "og", "s20", "diff", "pd", places=4)


@query
def d4_compare_strata(spark: SparkSession, sf: str) -> DataFrame:
    df = summary.compare(base(spark, sf, True), sampled(spark, sf, True), True, "og", "s20")
    return rounded(df, "og", "s20", "diff", "pd", places=4)


@query
def d5_ribbon_frame(spark: SparkSession, sf: str) -> DataFrame:
    df = summary.ribbon_frame(base(spark, sf), sampled(spark, sf), "og", "s20")
    return rounded(df, "mean", "se", "lci", "uci", places=4)


@query
def d6_density_frame(spark: SparkSession, sf: str) -> DataFrame:
    df = summary.density_frame(base(spark, sf), sampled(spark, sf), False, "og", "s20", points=POINTS)
    return rounded(df, "x", "density")


@query
def d7_diff_density(spark: SparkSession, sf: str) -> DataFrame:
    table = summary.compare(base(spark, sf, True), sampled(spark, sf, True), True, "og", "s20")
    return rounded(summary.diff_density(table, POINTS), "x", "density")


def _ess_frame(spark: SparkSession, sf: str) -> DataFrame:
    return staged_once(spark, f"scenarios {sf}", lambda: _scenarios(spark, sf))


@query
def d8_rank_index(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of all lengths within their species."""
    return distribution.rank_index(lfreq(spark, sf), ["species_code"], "length")


@query
def d8_box_frame(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.box_frame(_ess_frame(spark, sf)), "ymin", "lower", "middle", "upper", "ymax")


@query
def d8_box_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.box_outliers(_ess_frame(spark, sf)).drop("value"), "x")


@query
def d9_violin_frame(spark: SparkSession, sf: str) -> DataFrame:
    df = summary.violin_frame(_ess_frame(spark, sf), points=POINTS)
    return single(rounded(df, "x", "median"), "density")


@query
def d10_point_range(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.point_range(_ess_frame(spark, sf)), "mean", "se", "lci", "uci")


@query
def d10_point_range_chart(spark: SparkSession, sf: str) -> DataFrame:
    """The species that the effective-sample-size charts show, given as an argument."""
    return rounded(summary.point_range(_ess_frame(spark, sf), CHART_SPECIES), "mean", "se", "lci", "uci")


@query
def d11_point_range_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.point_range_by_year(_ess_frame(spark, sf)), "mean", "se", "lci", "uci")


# ---- effective sample size and sex ratio ---------------------------------------------------


@query
def e1_proportions(spark: SparkSession, sf: str) -> DataFrame:
    df = ess.proportions(base(spark, sf, True), ["year", "species_code", "stratum"], "og")
    return rounded(df, "og_m", "og_f", "og_t")


@query
def e2_ess_size(spark: SparkSession, sf: str) -> DataFrame:
    return single(ess.ess_size(sampled(spark, sf), base(spark, sf)), "value")


@query
def e3_ess_size_strata(spark: SparkSession, sf: str) -> DataFrame:
    return single(ess.ess_size(sampled(spark, sf, True), base(spark, sf, True), True), "value")


def _ages(spark: SparkSession, sf: str, sim: bool) -> DataFrame:
    size = sampled(spark, sf) if sim else base(spark, sf)
    return age.age_pop_est(specimen(spark, sf), size, YRS, sim)


@query
def e4_ess_age(spark: SparkSession, sf: str) -> DataFrame:
    return single(ess.ess_age(_ages(spark, sf, True), _ages(spark, sf, False)), "value")


@query
def e6_in_out(spark: SparkSession, sf: str) -> DataFrame:
    """The base against itself: every score is infinite, so only the flag is kept."""
    og = stage(simulate.simulate(lfreq(spark, sf), cpue(spark, sf), 1, None, YRS), "og")
    return ess.ess_size(og, og).drop("value")


@query
def e7_prop_fm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ess.prop_fm(sampled(spark, sf), base(spark, sf)), "prop_fm", "prop_fm_og")


@query
def e8_prop_fm_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios per stratum; an infinite one is shown as missing, for comparing by value."""
    df = ess.prop_fm(sampled(spark, sf, True), base(spark, sf, True), True)
    finite = {c: F.when(F.col(c) != float("inf"), F.col(c)) for c in ("prop_fm", "prop_fm_og")}
    return rounded(df.withColumns(finite), "prop_fm", "prop_fm_og")


# ---- age composition -----------------------------------------------------------------------


@query
def a1_sizepop_long(spark: SparkSession, sf: str) -> DataFrame:
    return age.sizepop_long(base(spark, sf))


@query
def a2_age_length_key(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(age.age_length_key(specimen(spark, sf)), "age_frac")


@query
def a3_sexed_age_pop(spark: SparkSession, sf: str) -> DataFrame:
    key = age.age_length_key(recent(specimen(spark, sf)))
    return rounded(age.sexed_age_pop(key, age.sizepop_long(base(spark, sf))), "agepop", places=4)


@query
def a4_unsexed_years(spark: SparkSession, sf: str) -> DataFrame:
    return age.unsexed_years(specimen(spark, sf))


@query
def a5_pooled_key(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(age.pooled_key(specimen(spark, sf)), "age_frac")


@query
def a6_unsexed_age_pop(spark: SparkSession, sf: str) -> DataFrame:
    key = age.pooled_key(recent(specimen(spark, sf)))
    return rounded(age.unsexed_age_pop(key, age.sizepop_long(base(spark, sf))), "agepop", places=4)


@query
def a7_ages_wide(spark: SparkSession, sf: str) -> DataFrame:
    aged, numbers = recent(specimen(spark, sf)), age.sizepop_long(base(spark, sf))
    sexed = age.sexed_age_pop(age.age_length_key(aged), numbers)
    wide = age.ages_wide(sexed, age.unsexed_age_pop(age.pooled_key(aged), numbers))
    return rounded(wide, "males", "females", "unsexed", places=4)


@query
def a8_age_pop_est(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_ages(spark, sf, False), "males", "females", "unsexed", places=4)


@query
def a8_age_pop_est_sim(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_ages(spark, sf, True), "males", "females", "unsexed", places=4)


