"""Replicated estimates: reduced sexing, sweeps over sample sizes and iterations, the bootstrap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcomp.functions.draw import SEED
from haulcomp.functions.rules import KH, replicate_keys
from haulcomp.operators.cells import since
from haulcomp.operators.ess import ess_size
from haulcomp.operators.sampling import EVERY_FISH, Run, newly_unsexed, removed_counts
from haulcomp.plans.population import bootstrapped, estimate_both, pop_est, resampled, resampled_with_removed
from haulcomp.sources.results import SUFFIX, read_result, write_result


def simulate(
    lfreq: DataFrame,
    cpue: DataFrame,
    iters: int = 1,
    samples: int | None = None,
    yrs: int | None = 2017,
    by_stratum: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """``iters`` independent estimates with a sim id each; without ``samples`` they are all the same."""
    if samples is None:
        size, _ = pop_est(lfreq, cpue, None, yrs, by_stratum)
        sims = F.explode(F.sequence(F.lit(1), F.lit(iters)))
        return size.select(sims.alias("sim"), "*")
    return resampled(lfreq, cpue, [Run(samples, iters)], yrs, by_stratum, seed).drop("run", "ss")


def simulate_both(
    lfreq: DataFrame, cpue: DataFrame, iters: int = 1, samples: int | None = None, yrs: int | None = 2017, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """``simulate`` for the whole survey and by stratum, from one draw."""
    if samples is None:
        sims = F.explode(F.sequence(F.lit(1), F.lit(iters))).alias("sim")
        return tuple(df.select(sims, "*") for df in estimate_both(lfreq, cpue, yrs))
    return tuple(df.drop("run", "ss") for df in estimate_both(lfreq, cpue, yrs, [Run(samples, iters)], seed))


def removed(
    lfreq: DataFrame, iters: int, samples: int, yrs: int | None = 2017, seed: int = SEED
) -> DataFrame:
    """The fish each replicate moved to unsexed."""
    return newly_unsexed(since(lfreq, yrs), [Run(samples, iters)], seed).drop("run", "ss")


def removed_summary(removed_fish: DataFrame, iters: int) -> DataFrame:
    """Mean number of fish removed per haul, counted from the removed fish; ``removed_mean`` needs none."""
    n = F.try_divide(F.count("id"), F.lit(iters))
    labels = [c for c in replicate_keys(removed_fish) if c != "sim"]
    return removed_fish.groupBy(*labels, *KH).agg(n.alias("ss_removed"))


def removed_mean(lfreq: DataFrame, samples: int, yrs: int | None = 2017) -> DataFrame:
    """``removed_summary`` of any number of replicates, without a draw."""
    return removed_counts(since(lfreq, yrs), samples)


def sims(
    lfreq: DataFrame,
    cpue: DataFrame,
    iters: int = 1,
    samples: int | None = None,
    yrs: int | None = 2017,
    by_stratum: bool = False,
    save: str | None = None,
    removed_summ: bool = False,
    folder: str | None = None,
    seed: int = SEED,
    fmt: str = "csv",
) -> DataFrame:
    """``simulate`` with the save rules.

    With ``samples`` a ``save`` name is required: the numbers go to <save>_size and the removed fish to
    <save>_removed, or their count per haul to <save>_removed_summ. Without ``samples``, <save> if given.
    Numbers and removed fish come from one draw; the count per haul needs none.
    """
    if samples is not None and save is None:
        raise ValueError("a run with a sample size writes two tables; name them with save")
    if save is not None and folder is None:
        raise ValueError("saving needs a folder")
    fish = None
    if samples is None or removed_summ:
        size = simulate(lfreq, cpue, iters, samples, yrs, by_stratum, seed)
    else:
        size, fish = [df.drop("run", "ss") for df in resampled_with_removed(lfreq, cpue, [Run(samples, iters)], yrs, by_stratum, seed)]
    if save is None:
        return size
    name = save + SUFFIX["single" if samples is None else "size"]
    write_result(size, folder, name, fmt)
    if fish is not None:
        write_result(fish, folder, save + SUFFIX["removed"], fmt)
    elif samples is not None:
        write_result(removed_mean(lfreq, samples, yrs), folder, save + SUFFIX["removed_summary"], fmt)
    return read_result(size.sparkSession, folder, name, dict(size.dtypes), fmt)


def sweep(
    lfreq: DataFrame,
    cpue: DataFrame,
    samples: Sequence[int] = (20, 40, 60, 80, 100, 120, 140),
    iters: int = 10,
    yrs: int | None = 2017,
    by_stratum: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """All sample sizes in one job; ``ss`` tells which. Each equals ``simulate`` at that size."""
    runs = [Run(n, iters) for n in samples]
    return resampled(lfreq, cpue, runs, yrs, by_stratum, seed).drop("run")


def sweep_both(
    lfreq: DataFrame,
    cpue: DataFrame,
    samples: Sequence[int] = (20, 40, 60, 80, 100, 120, 140),
    iters: int = 10,
    yrs: int | None = 2017,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """``sweep`` for the whole survey and by stratum, from one draw."""
    return tuple(df.drop("run") for df in estimate_both(lfreq, cpue, yrs, [Run(n, iters) for n in samples], seed))


def sweep_iters(
    lfreq: DataFrame,
    cpue: DataFrame,
    iters: Sequence[int] = (20, 40, 60, 80, 100, 120),
    samples: int = 80,
    yrs: int | None = 2017,
    by_stratum: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """One run per number of replicates, in one job; ``run`` is that number, and runs are independent."""
    runs = [Run(samples, n, label=n) for n in iters]
    return resampled(lfreq, cpue, runs, yrs, by_stratum, seed).drop("ss")


def pop_est_boot(
    lfreq: DataFrame,
    cpue: DataFrame,
    samples: int | None = 10000,
    yrs: int | None = None,
    by_stratum: bool = False,
    boot: int = 1,
    seed: int = SEED,
) -> DataFrame:
    """Estimates on ``boot`` bootstraps of hauls and lengths; samples=None keeps every fish."""
    return bootstrapped(lfreq, cpue, [Run(samples, boot)], yrs, by_stratum, seed).drop("run", "ss")


def sims_boot(
    lfreq: DataFrame,
    cpue: DataFrame,
    og: DataFrame,
    samples: int | None = None,
    yrs: int | None = None,
    by_stratum: bool = False,
    boot: int = 500,
    seed: int = SEED,
) -> DataFrame:
    """Effective sample size of each bootstrap against ``og``."""
    return ess_size(pop_est_boot(lfreq, cpue, samples, yrs, by_stratum, boot, seed), og, by_stratum)


def sweep_boot(
    lfreq: DataFrame,
    cpue: DataFrame,
    og: DataFrame,
    samples: Sequence[int | None] = (None, 20, 40, 60, 80, 100, 120, 140),
    yrs: int | None = None,
    by_stratum: bool = False,
    boot: int = 500,
    seed: int = SEED,
) -> DataFrame:
    """``sims_boot`` for many sample sizes in one job, with type and ss: base and 0 where every fish is kept."""
    runs = [Run(n, boot) for n in samples]
    scores = ess_size(bootstrapped(lfreq, cpue, runs, yrs, by_stratum, seed).drop("run"), og, by_stratum)
    every = F.col("ss") == EVERY_FISH
    label = F.when(every, "base").otherwise(F.format_string("s%03d", F.col("ss")))
    return scores.withColumns({"type": label, "ss": F.when(every, 0).otherwise(F.col("ss"))})


def label_scenarios(scenarios: Mapping[str, tuple[int, DataFrame]]) -> DataFrame:
    """Stack scenarios {type: (ss, frame)} with type and ss columns; the base has ss 0."""
    out = None
    for name, (ss, df) in scenarios.items():
        one = df.withColumns({"type": F.lit(name), "ss": F.lit(ss)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


