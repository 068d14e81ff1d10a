"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The survey tables are derived from the test tables first and timed as ``tables``; every
other time runs from those files to a fully computed result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from haulcomp.functions.draw import SEED  # noqa: E402
from haulcomp.operators import age, ess, summary  # noqa: E402
from haulcomp.plans import population, simulate  # noqa: E402
from haulcomp.session import local_session, stage  # noqa: E402
from haulcomp.sources import fixtures  # noqa: E402

YRS = 1997


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session("bench", cores, int(os.environ.get("BENCH_PARTITIONS", "8")))
    times: dict[str, float] = {}

    def timed(name: str, build):
        start = time.time()
        out = stage(build(), name)
        times[name] = round(time.time() - start, 3)
        return out

    def tables():
        items = stage(fixtures.base(spark, sf_dir), "items")
        return [stage(getattr(fixtures, n)(spark, sf_dir, items), n) for n in ("lfreq", "cpue", "specimen")]

    start = time.time()
    lfreq, cpue, specimen = tables()
    times["tables"] = round(time.time() - start, 3)
    lfreq, cpue = lfreq.drop("survey"), cpue.drop("survey")
    specimen = specimen.drop("region").filter("age IS NOT NULL")

    og = timed("p18_base", lambda: population.pop_est(lfreq, cpue, None, YRS)[0])
    og_st = timed("p18_base_strata", lambda: population.pop_est(lfreq, cpue, None, YRS, True)[0])
    timed("c1_s40_x10", lambda: simulate.simulate(lfreq, cpue, 10, 40, YRS))
    sims = timed("c1_s40_x100", lambda: simulate.simulate(lfreq, cpue, 100, 40, YRS))
    sims_st = timed("c1_s20_x10_strata", lambda: simulate.simulate(lfreq, cpue, 10, 20, YRS, True))
    timed("c2_removed_s40_x10", lambda: simulate.removed(lfreq, 10, 40, YRS))
    timed("c5_sweep_7x10", lambda: simulate.sweep(lfreq, cpue, iters=10, yrs=YRS))
    timed("c8_boot_x10", lambda: simulate.pop_est_boot(lfreq, cpue, 10000, YRS, False, 10, SEED))
    timed("c8_boot_x100", lambda: simulate.pop_est_boot(lfreq, cpue, 10000, YRS, False, 100, SEED))
    timed("c1_s40_x10_both", lambda: simulate.simulate_both(lfreq, cpue, 10, 40, YRS, SEED)[1])
    timed("d4_compare_strata", lambda: summary.compare(og_st, sims_st, True))
    timed("e2_ess_size", lambda: ess.ess_size(sims, og))
    timed("e3_ess_size_strata", lambda: ess.ess_size(sims_st, og_st, True))
    timed("e7_prop_fm", lambda: ess.prop_fm(sims, og))
    og_age = timed("a8_age_base", lambda: age.age_pop_est(specimen, og, YRS))
    sim_age = timed("a8_age_x100", lambda: age.age_pop_est(specimen, sims, YRS, True))
    timed("e4_ess_age", lambda: ess.ess_age(sim_age, og_age))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir,
                      "master": spark.sparkContext.master, "partitions": spark.conf.get("spark.sql.shuffle.partitions")}))


if __name__ == "__main__":
    main()
