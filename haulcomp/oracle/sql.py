"""SQL for every query of ``catalog``, in DuckDB's dialect.

One common table expression per step, one row per fish or sex, no compact forms: slow and
direct on purpose. ``statement`` collects the steps a query needs.
"""

from __future__ import annotations

import re

from haulcomp.catalog import ITERS, ITERS_SAMPLES, POINTS, SAMPLES, SEED, SIMS, SURVEY, SWEEP, YRS

EVERY_FISH = -1
K = "year, species_code, stratum"
KH = f"{K}, hauljoin"
REP = "run, ss, sim, "
STEPS: dict[str, str] = {}


def div(a: str, b: str) -> str:
    return (
        f"CASE WHEN ({b}) = 0 THEN CASE WHEN ({a}) > 0 THEN CAST('Infinity' AS DOUBLE) "
        f"WHEN ({a}) < 0 THEN CAST('-Infinity' AS DOUBLE) END ELSE CAST(({a}) AS DOUBLE) / ({b}) END"
    )


def strict(agg: str, x: str, over: str = "") -> str:
    return f"CASE WHEN COUNT({x}){over} = COUNT(*){over} THEN {agg}({x}){over} END"


def whole(x: str) -> str:
    halves = f"round_even(({x}) * 2, 0)"
    return f"CASE WHEN abs(({x}) * 2 - {halves}) <= abs({x}) * 1e-12 THEN round_even({halves} / 2, 0) ELSE round_even({x}, 0) END"


def draw(n: str, stage: str, *parts: str) -> str:
    text = f"concat_ws('|', {SEED}, '{stage}', {', '.join(parts)})"
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) % {n} + 1"


def r(x: str, places: int = 6, name: str | None = None) -> str:
    return f"round({x}, {places}) AS {name or x}"


def single(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE) AS {x}"


def statement(final: str) -> str:
    """``final`` with the steps it mentions, and those they mention, in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\b[a-z][a-z0-9_]*\b", text)) & set(STEPS)):
            if name not in order:
                visit(STEPS[name])
                if name not in order:
                    order.append(name)

    visit(final)

    def form(name: str) -> str:
        # The bootstrap reads these twice; written out once they can't be reordered into each other.
        return f"{name} AS MATERIALIZED ({STEPS[name]})" if name == "numbered" or re.fullmatch(r"b(b|\d+)_[hl]", name) else f"{name} AS ({STEPS[name]})"

    steps = ",\n".join(map(form, order))
    return f"WITH {steps}\n{final}" if order else final


# ---- the test tables as survey tables ------------------------------------------------------

SURVEY_CASE = """CASE n_regionkey WHEN 0 THEN 'AI' WHEN 1 THEN 'GOA' WHEN 2 THEN 'EBS'
                        WHEN 3 THEN 'BSS' ELSE 'NBS' END"""

STEPS["fx_base"] = f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
       sp, CASE sp WHEN 1 THEN 10110 WHEN 2 THEN 10120 WHEN 3 THEN 10130 WHEN 4 THEN 21720 WHEN 5 THEN 21740 ELSE 21921 END
           AS species_code,
       {SURVEY_CASE} AS survey,
       s_nationkey AS stratum,
       CAST(year(o_orderdate) AS BIGINT) * 1000000 + l_suppkey AS hauljoin,
       l_suppkey,
       CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS sex,
       CAST(p_size * 10 AS INTEGER) AS length,
       CAST(ceil(l_quantity / 10) AS INTEGER) AS frequency,
       CAST(l_quantity AS BIGINT) AS qty, l_linenumber, l_discount, p_size
FROM (SELECT *, CASE WHEN (l_suppkey + kind) % 6 = 0 THEN kind % 6 + 1 ELSE kind END AS sp FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                              WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS kind FROM part) p ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey)"""
STEPS["fx_strata"] = f"""
SELECT {SURVEY_CASE} AS survey, n_nationkey AS stratum, CAST((n_nationkey + 1) * 100 AS DOUBLE) AS area
FROM nation"""
STEPS["fx_lfreq"] = "SELECT survey, year, species_code, stratum, hauljoin, sex, length, frequency FROM fx_base"
STEPS["fx_mistyped"] = """
SELECT survey, CAST(year AS VARCHAR) AS year, CAST(species_code AS VARCHAR) AS species_code, CAST(stratum AS VARCHAR) AS stratum,
       CAST(hauljoin AS VARCHAR) AS hauljoin, CAST(sex AS VARCHAR) AS sex,
       CASE WHEN length = 100 THEN '1OO' ELSE CAST(length AS VARCHAR) END AS length,
       CASE WHEN sex <> 3 THEN CAST(frequency AS VARCHAR) WHEN frequency = 5 THEN 'several' ELSE 'NA' END AS frequency
FROM fx_lfreq"""
STEPS["fx_orders"] = f"""
SELECT {SURVEY_CASE} AS survey, CAST(year(o_orderdate) AS INTEGER) AS year, c_nationkey AS stratum,
       -CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + c_nationkey AS BIGINT) AS hauljoin,
       CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END AS sp,
       CAST(floor(o_totalprice / 10000) AS BIGINT) + 1 AS qty
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
STEPS["fx_caught"] = """
SELECT survey, year, stratum, hauljoin, sp, qty FROM fx_base UNION ALL SELECT survey, year, stratum, hauljoin, sp, qty FROM fx_orders"""
STEPS["fx_cpue"] = """
SELECT h.survey, h.year, s.species_code,
       CASE WHEN c.q IS NOT NULL THEN h.hauljoin * 10 + s.sp END AS catchjoin,
       h.hauljoin, h.stratum, CAST(coalesce(c.q, 0) AS DOUBLE) AS numcpue, t.area
FROM (SELECT DISTINCT survey, year, stratum, hauljoin FROM fx_caught) h
CROSS JOIN (SELECT DISTINCT sp, species_code FROM fx_base) s
LEFT JOIN (SELECT hauljoin, sp, SUM(qty) AS q FROM fx_caught GROUP BY hauljoin, sp) c
  ON c.hauljoin = h.hauljoin AND c.sp = s.sp
LEFT JOIN fx_strata t ON t.stratum = h.stratum"""
STEPS["fx_specimen"] = """
SELECT survey AS region, year, species_code, stratum, hauljoin, CASE WHEN sex = 3 AND year % 2 = 1 THEN 2 ELSE sex END AS sex, length,
       CASE WHEN l_discount > 0.08 THEN NULL
            ELSE CAST(floor(p_size / 5) AS INTEGER) + l_linenumber END AS age
FROM fx_base"""

STEPS["lf"] = f"SELECT {KH}, sex, length, frequency FROM fx_lfreq WHERE year >= {YRS}"
STEPS["cp"] = f"SELECT {K}, catchjoin, hauljoin, numcpue, area FROM fx_cpue WHERE year >= {YRS}"
STEPS["lf_all"] = f"SELECT {KH}, sex, length, frequency FROM fx_lfreq"
STEPS["cp_all"] = f"SELECT {K}, catchjoin, hauljoin, numcpue, area FROM fx_cpue"
STEPS["spec_all"] = f"SELECT {KH}, sex, length, age FROM fx_specimen WHERE age IS NOT NULL"
STEPS["spec"] = f"SELECT {KH}, sex, length, age FROM fx_specimen WHERE age IS NOT NULL AND year >= {YRS}"

# ---- grid, abundance -----------------------------------------------------------------------

_SPECIES_LENGTHS = "(SELECT DISTINCT species_code, length FROM fx_lfreq) a"
_SPECIES_YEARS = f"(SELECT DISTINCT species_code, year FROM fx_lfreq WHERE year >= {YRS}) b USING (species_code)"
STEPS["grid"] = f"SELECT b.year, species_code, a.length FROM {_SPECIES_LENGTHS} JOIN {_SPECIES_YEARS}"
_ALL_YEARS = "(SELECT DISTINCT species_code, year FROM fx_lfreq) b USING (species_code)"
STEPS["grid_all"] = f"SELECT b.year, species_code, a.length FROM {_SPECIES_LENGTHS} JOIN {_ALL_YEARS}"
STEPS["grid_st_all"] = f"""
SELECT b.year, species_code, c.stratum, a.length FROM {_SPECIES_LENGTHS} JOIN {_ALL_YEARS}
JOIN (SELECT DISTINCT species_code, stratum FROM fx_lfreq) c USING (species_code)"""
STEPS["grid_st"] = f"""
SELECT b.year, species_code, c.stratum, a.length FROM {_SPECIES_LENGTHS} JOIN {_SPECIES_YEARS}
JOIN (SELECT DISTINCT species_code, stratum FROM fx_lfreq) c USING (species_code)"""
for _pop, _cp in (("pop", "cp"), ("pop_all", "cp_all")):
    STEPS[_pop] = f"""
SELECT {KH}, {div(strict('AVG', 'numcpue', f' OVER (PARTITION BY {KH})'), strict('SUM', 'numcpue', f' OVER (PARTITION BY {K})'))}
       * ({strict('AVG', 'numcpue', f' OVER (PARTITION BY {K})')} * area) AS abund
FROM {_cp}"""


def estimate(name: str, freq: str, rep: str, tail_all: str = "") -> None:
    """Steps from frequencies (per replicate ``rep``) to numbers at length; ``tail_all`` "_all" takes every year."""
    on = "".join(f" AND m.{c} = r.{c}" for c in rep.replace(" ", "").split(",") if c)
    reps = f", (SELECT DISTINCT {rep.rstrip(', ')} FROM {freq}) r" if rep else ""
    STEPS[f"{name}_nh"] = f"SELECT {rep}{K}, COUNT(DISTINCT hauljoin) AS nhauls FROM {freq} GROUP BY ALL"
    STEPS[f"{name}_tot"] = f"SELECT {rep}{KH}, {strict('SUM', 'frequency')} AS tot FROM {freq} GROUP BY ALL"
    STEPS[f"{name}_sum"] = f"SELECT {rep}{KH}, sex, length, {strict('SUM', 'frequency')} AS f FROM {freq} GROUP BY ALL"
    STEPS[f"{name}_comp"] = f"""
SELECT {rep}{KH}, sex, length, {div('f', 'tot')} AS comp, nhauls
FROM {name}_sum JOIN {name}_tot USING ({rep}{KH}) JOIN {name}_nh USING ({rep}{K})"""
    STEPS[f"{name}_unk"] = f"""
SELECT {rep}{K}, sex, length, ({strict('SUM', 'comp')}) / MAX(nhauls) AS comp FROM {name}_comp GROUP BY {rep}{K}, sex, length"""
    STEPS[f"{name}_nolen"] = f"""
SELECT {rep}{K}, hauljoin, catchjoin, numcpue, area FROM cp{tail_all} c{reps}
WHERE catchjoin IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {freq} m WHERE m.hauljoin = c.hauljoin{on})"""
    STEPS[f"{name}_imp"] = f"""
SELECT {rep}{KH}, sex, length, comp FROM {name}_nolen LEFT JOIN {name}_unk USING ({rep}{K})
UNION ALL SELECT {rep}{KH}, sex, length, comp FROM {name}_comp"""
    STEPS[f"{name}_exp"] = f"""
SELECT {rep}{KH}, sex, length, comp, abund, {whole('comp * abund')} AS sz_pop FROM {name}_imp LEFT JOIN pop{tail_all} USING ({KH})"""
    for tail, grid, keys in (("size", f"grid{tail_all}", "year, species_code, length"), ("size_st", f"grid_st{tail_all}", f"{K}, length")):
        STEPS[f"{name}_{tail}_sum"] = f"""
SELECT {rep}{keys}, sex, coalesce(SUM(sz_pop), 0) AS abund FROM {name}_exp GROUP BY {rep}{keys}, sex"""
        STEPS[f"{name}_{tail}_wide"] = f"""
SELECT {rep}{keys}, SUM(CASE WHEN sex = 1 THEN abund END) AS males, SUM(CASE WHEN sex = 2 THEN abund END) AS females,
       SUM(CASE WHEN sex = 3 THEN abund END) AS unsexed
FROM {name}_{tail}_sum GROUP BY {rep}{keys}"""
        grid_reps = f"{grid} g{reps}" if rep else f"{grid} g"
        STEPS[f"{name}_{tail}"] = f"""
SELECT {rep}{keys}, coalesce(males, 0.0) AS males, coalesce(females, 0.0) AS females, coalesce(unsexed, 0.0) AS unsexed
FROM (SELECT * FROM {grid_reps}) LEFT JOIN {name}_{tail}_wide USING ({rep}{keys})"""


# ---- fish and draws ------------------------------------------------------------------------


def fish(name: str, rows: str, rep: str) -> None:
    STEPS[name] = f"""
SELECT {rep}{KH}, sex, length, CAST(o AS BIGINT) AS ordinal, concat_ws('|', {KH}, sex, length, o) AS id,
       COUNT(*) OVER (PARTITION BY {rep}{KH}, sex = 3) AS n
FROM (SELECT {rep}{KH}, sex, length, CAST(SUM(frequency) AS BIGINT) AS f FROM {rows} WHERE frequency > 0 GROUP BY ALL),
     UNNEST(range(1, f + 1)) AS u(o)"""


def reps(name: str, runs: list[tuple[int, int, int]]) -> None:
    values = ", ".join(f"({run}, {ss}, {iters})" for run, ss, iters in runs)
    STEPS[name] = f"""
SELECT run, ss, CAST(s AS INTEGER) AS sim FROM (VALUES {values}) AS t(run, ss, iters), UNNEST(range(1, iters + 1)) AS u(s)"""


def ranked(name: str, fish_step: str, source: str) -> None:
    """Rank of each sexed fish in its haul, and the frequencies once those beyond ss are unsexed."""
    STEPS[f"{name}_rank"] = f"""
SELECT {REP}{KH}, sex, length, ordinal, id, n,
       row_number() OVER (PARTITION BY {REP}{KH} ORDER BY md5(concat_ws('|', {SEED}, 'fish', run, ss, sim, id)), sex, length, ordinal) AS rk
FROM {source} WHERE sex <> 3"""
    STEPS[f"{name}_freq"] = f"""
SELECT {REP}{KH}, sex, length, COUNT(*) AS frequency FROM (
  SELECT {REP}{KH}, CASE WHEN ss >= 0 AND rk > ss THEN 3 ELSE sex END AS sex, length FROM {name}_rank
  UNION ALL SELECT {REP}{KH}, sex, length FROM {source} WHERE sex = 3) GROUP BY ALL"""


estimate("og", "lf", "")
estimate("al", "lf_all", "", "_all")
fish("all_fish", "lf", "")
fish("fish_all", "lf_all", "")


def simulated(name: str, runs: list[tuple[int, int, int]]) -> None:
    reps(f"{name}_reps", runs)
    STEPS[f"{name}_fish"] = f"SELECT * FROM all_fish, {name}_reps"
    ranked(name, "all_fish", f"{name}_fish")
    estimate(name, f"{name}_freq", REP)


def booted(name: str, samples: int | None) -> None:
    reps(f"{name}_reps", [(0, EVERY_FISH if samples is None else samples, SIMS)])
    # Element j of a sorted list stands for the row drawn; a join of the rows with themselves says the same but takes far longer.
    who = f"run, ss, sim, {K}, ordinal"
    STEPS[f"{name}_h"] = f"""
SELECT {REP}{K}, (hauls[j]).h AS hauljoin, ordinal, sex, length, frequency
FROM (SELECT *, {draw('n', 'haul', who)} AS j FROM numbered JOIN donors USING ({K}), {name}_reps)"""
    STEPS[f"{name}_l"] = f"SELECT {REP}{KH}, list(length ORDER BY length) AS lengths, COUNT(*) AS nl FROM {name}_h GROUP BY ALL"
    STEPS[f"{name}_rows"] = f"""
SELECT {REP}{KH}, ordinal, sex, lengths[j] AS length, frequency
FROM (SELECT * EXCLUDE (length), {draw('nl', 'length', who)} AS j FROM {name}_h JOIN {name}_l USING ({REP}{KH}))"""
    fish(f"{name}_fish", f"{name}_rows", REP)
    ranked(name, f"{name}_fish", f"{name}_fish")
    estimate(name, f"{name}_freq", REP)


STEPS["numbered"] = f"""
SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY md5(concat_ws('|', hauljoin, sex, length, frequency)),
                             hauljoin, sex, length, frequency) AS ordinal,
       COUNT(*) OVER (PARTITION BY {K}) AS n
FROM lf"""
STEPS["donors"] = f"SELECT {K}, list({{'o': ordinal, 'h': hauljoin}} ORDER BY ordinal) AS hauls FROM numbered GROUP BY {K}"
simulated("s1", [(0, SAMPLES, 1)])
STEPS["sa_fish"] = "SELECT * FROM fish_all, s1_reps"
ranked("sa", "fish_all", "sa_fish")
simulated("sim", [(0, SAMPLES, SIMS)])
simulated("swp", [(0, n, SIMS) for n in SWEEP])
simulated("itr", [(n, ITERS_SAMPLES, n) for n in ITERS])
BOOTS = {"base": ("bb", 0, None), **{f"s{n:03d}": (f"b{n}", n, n) for n in SWEEP}}
for _name, _ss, _samples in BOOTS.values():
    booted(_name, _samples)

# ---- effective sample size, sex ratio ------------------------------------------------------


def shares(name: str, table: str, keys: str, at: str, prefix: str, keep: bool) -> None:
    over = f" OVER (PARTITION BY {keys})"
    m, f, u = [strict("SUM", c, over) for c in ("males", "females", "unsexed")]
    cols = f"""
SELECT {keys}, {at}, {div('males', m)} AS {prefix}_m, {div('females', f)} AS {prefix}_f,
       {div('males + females + unsexed', f'({m}) + ({f}) + ({u})')} AS {prefix}_t FROM {table}"""
    if not keep:
        cols = f"SELECT * FROM ({cols}) WHERE {prefix}_m >= 0 AND {prefix}_f >= 0 AND {prefix}_t >= 0"
    STEPS[name] = cols


def score(name: str, sim: str, og: str, rep: str, groups: str, at: str, age: bool = False) -> None:
    shares(f"{name}_p", sim, rep + groups, at, "prop", age)
    shares(f"{name}_q", og, groups, at, "og", age)
    parts = ", ".join(
        div(strict("SUM", f"prop_{x} * (1 - prop_{x})"), strict("SUM", f"pow(CASE WHEN abs(prop_{x} - og_{x}) <= greatest(prop_{x}, og_{x}) * 1e-12 THEN 0 ELSE prop_{x} - og_{x} END, 2)"))
        + f" AS ess_{x}"
        for x in "fmt"
    )
    STEPS[f"{name}_w"] = f"""
SELECT {rep}{groups}, {parts} FROM {name}_p LEFT JOIN {name}_q USING ({groups}, {at}) GROUP BY {rep}{groups}"""
    kept = "" if age else " WHERE ess_f IS NOT NULL AND ess_m IS NOT NULL AND ess_t IS NOT NULL"
    flag = "" if age else ", CASE WHEN isinf(value) THEN 'out' ELSE 'in' END AS in_out"
    each = " UNION ALL ".join(f"SELECT {rep}{groups}, 'ess_{x}' AS ess, ess_{x} AS value FROM {name}_w{kept}" for x in "fmt")
    STEPS[name] = f"SELECT *{flag} FROM ({each})"


score("e2", "sim_size", "og_size", "sim, ", "year, species_code", "length")
score("e3", "sim_size_st", "og_size_st", "sim, ", K, "length")
score("e6", "og_one", "og_size", "sim, ", "year, species_code", "length")
STEPS["og_one"] = "SELECT 1 AS sim, * FROM og_size"
for _name, _ss, _samples in BOOTS.values():
    score(f"{_name}_ess", f"{_name}_size", "og_size", "sim, ", "year, species_code", "length")
STEPS["scen"] = " UNION ALL ".join(
    f"SELECT sim, year, species_code, ess, value, in_out, '{label}' AS type, {ss} AS ss FROM {name}_ess"
    for label, (name, ss, _) in BOOTS.items()
)


def ratio(name: str, sim: str, og: str, groups: str) -> None:
    q = div(strict("SUM", "females"), strict("SUM", "males"))
    STEPS[name] = f"""
SELECT * FROM (SELECT sim, {groups}, {q} AS prop_fm FROM {sim} GROUP BY sim, {groups})
LEFT JOIN (SELECT {groups}, {q} AS prop_fm_og FROM {og} GROUP BY {groups}) USING ({groups})
WHERE prop_fm >= 0 AND prop_fm_og >= 0"""


ratio("e7", "sim_size", "og_size", "year, species_code")
ratio("e8", "sim_size_st", "og_size_st", K)

# ---- age -----------------------------------------------------------------------------------


def long_size(name: str, table: str, rep: str) -> None:
    STEPS[name] = " UNION ALL ".join(
        f"SELECT {rep}year, species_code, length, {code} AS sex, {col} AS sizepop FROM {table}"
        for code, col in ((1, "males"), (2, "females"), (3, "unsexed"))
    )


long_size("og_long", "og_size", "")
long_size("sim_long", "sim_size", "sim, ")


def key(name: str, rows: str, at: str) -> None:
    STEPS[name] = f"""
SELECT {at}, age, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY {at}) AS age_frac
FROM (SELECT {at}, age, COUNT(*) AS n FROM {rows} GROUP BY ALL)"""


key("akey", "spec", "year, species_code, sex, length")
key("akey_all", "spec_all", "year, species_code, sex, length")
STEPS["unsexed_yr_all"] = "SELECT DISTINCT year, species_code FROM spec_all WHERE sex = 3"
STEPS["spec_un_all"] = "SELECT spec_all.* FROM spec_all JOIN unsexed_yr_all USING (year, species_code)"
key("pkey_all", "spec_un_all", "year, species_code, length")
STEPS["unsexed_yr"] = "SELECT DISTINCT year, species_code FROM spec WHERE sex = 3"
STEPS["spec_un"] = "SELECT spec.* FROM spec JOIN unsexed_yr USING (year, species_code)"
key("pkey", "spec_un", "year, species_code, length")
_total = strict("SUM", "age_frac * sizepop")
STEPS["a3"] = f"""
SELECT year, species_code, sex, age, {_total} AS agepop
FROM akey LEFT JOIN og_long USING (year, species_code, sex, length) WHERE sex <= 2 GROUP BY ALL"""
STEPS["a6"] = f"""
SELECT year, species_code, CASE WHEN COUNT(u.sex) > 0 THEN 3 END AS sex, age, {_total} AS agepop
FROM pkey LEFT JOIN (SELECT * FROM og_long WHERE sex = 3) u USING (year, species_code, length) GROUP BY year, species_code, age"""
STEPS["a3_sim"] = """
SELECT sim, year, species_code, sex, age, SUM(age_frac * sizepop) AS agepop
FROM akey JOIN sim_long USING (year, species_code, sex, length) WHERE sex <= 2 GROUP BY ALL"""
STEPS["a6_sim"] = """
SELECT sim, year, species_code, 3 AS sex, age, SUM(age_frac * sizepop) AS agepop
FROM pkey JOIN (SELECT * FROM sim_long WHERE sex = 3) u USING (year, species_code, length) GROUP BY sim, year, species_code, age"""


def ages(name: str, mf: str, un: str, rep: str) -> None:
    cols = ", ".join(
        f"CASE WHEN COUNT(*) FILTER (sex = {code}) = 0 THEN 0.0 ELSE MAX(agepop) FILTER (sex = {code}) END AS {col}"
        for code, col in ((3, "unsexed"), (1, "males"), (2, "females"))
    )
    STEPS[name] = f"""
SELECT {rep}year, species_code, age, {cols}
FROM (SELECT * FROM {mf} UNION ALL BY NAME SELECT * FROM {un}) GROUP BY {rep}year, species_code, age"""


ages("og_age", "a3", "a6", "")
ages("sim_age", "a3_sim", "a6_sim", "sim, ")
score("e4", "sim_age", "og_age", "sim, ", "year, species_code", "age", age=True)

# ---- summaries -----------------------------------------------------------------------------


def bins(name: str, table: str, keys: str, label: str, where: str = "") -> None:
    long = " UNION ALL ".join(
        f"SELECT {keys}, length, '{c}' AS name, {c} AS value FROM {table}{where}" for c in ("males", "females", "unsexed")
    )
    STEPS[name] = f"""
SELECT *, mean - 1.96 * se AS lci, mean + 1.96 * se AS uci, '{label}' AS id FROM (
  SELECT {keys}, name, length, AVG(value) AS mean, stddev_samp(value) / sqrt(COUNT(*)) AS se FROM ({long}) GROUP BY ALL)"""


bins("d2", "sim_size", "year, species_code", "s20")
bins("d2_st", "sim_size_st", K, "s20_st")
bins("d2_swp", "swp_size", "ss, year, species_code", "sweep")
bins("d2_og", "og_size", "year, species_code", "og")
bins("d2_og_st", "og_size_st", K, "og")


def compared(name: str, og: str, sim: str, keys: str) -> None:
    STEPS[name] = f"""
SELECT *, og - s20 AS diff, {div('og - s20', '(og + s20) / 2')} * 100 AS pd FROM (
  SELECT {keys}, name, AVG(mean) FILTER (src = 'og') AS og, AVG(mean) FILTER (src = 's20') AS s20
  FROM (SELECT {keys}, name, mean, 'og' AS src FROM {og} UNION ALL SELECT {keys}, name, mean, 's20' FROM {sim}) GROUP BY ALL)"""


compared("d4", "d2_og", "d2", "year, species_code")
STEPS["d2_og_swp"] = "SELECT DISTINCT s.ss, o.* FROM d2_og o, (SELECT DISTINCT ss FROM swp_reps) s"
compared("d4_swp", "d2_og_swp", "d2_swp", "ss, year, species_code")
compared("d4_st", "d2_og_st", "d2_st", K)


def curves(name: str, table: str, keys: str, value: str, panel: str) -> None:
    """Kernel density on POINTS points; ``panel`` keys share a range."""
    over = f"PARTITION BY {panel}" if panel else ""
    STEPS[f"{name}_v"] = f"""
SELECT {keys}, {value} AS v, MIN({value}) OVER ({over}) AS lo, MAX({value}) OVER ({over}) AS hi
FROM {table} WHERE {value} IS NOT NULL AND NOT isinf({value})"""
    STEPS[f"{name}_b"] = f"""
SELECT {keys}, n, lo, hi, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd
       WHEN v0 <> 0 THEN abs(v0) ELSE 1 END * pow(n, -0.2) AS bw FROM (
  SELECT {keys}, COUNT(*) AS n, MAX(lo) AS lo, MAX(hi) AS hi, stddev_samp(v) AS sd, MIN(v) AS v0,
         quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr
  FROM {name}_v GROUP BY {keys}) WHERE n > 1"""
    STEPS[name] = f"""
SELECT {keys}, point, x, SUM(exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (MAX(n) * MAX(bw) * sqrt(2 * pi())) AS density FROM (
  SELECT {keys}, b.n, b.bw, p AS point, v.v, b.lo + (p - 1) * (b.hi - b.lo) / {POINTS - 1} AS x
  FROM {name}_v v JOIN {name}_b b USING ({keys}), UNNEST(range(1, {POINTS + 1})) AS u(p)) GROUP BY {keys}, point, x"""


STEPS["d6_in"] = """
SELECT species_code, name, 'og' AS data, og / 1000 AS value FROM d4
UNION ALL SELECT species_code, name, 's20', s20 / 1000 FROM d4"""
curves("d6", "d6_in", "species_code, name, data", "value", "species_code, name")
curves("d7", "d4_st", "stratum", "diff", "")
STEPS["chart"] = f"""
SELECT *, {div('1', 'value')} AS x FROM scen WHERE ess <> 'ess_t'"""
STEPS["inverse"] = "SELECT * FROM chart WHERE x IS NOT NULL AND NOT isinf(x)"
_box = "species_code, ess, type"
STEPS["boxes"] = f"""
SELECT {_box}, COUNT(*) AS n, quantile_cont(x, 0.25) AS lower, quantile_cont(x, 0.5) AS middle, quantile_cont(x, 0.75) AS upper
FROM inverse GROUP BY {_box}"""
STEPS["boxed"] = f"""
SELECT *, x >= lower - 1.5 * (upper - lower) AND x <= upper + 1.5 * (upper - lower) AS inside
FROM inverse JOIN boxes USING ({_box})"""
curves("d9", "inverse", _box, "x", _box)


def points(name: str, keys: str) -> None:
    STEPS[name] = f"""
SELECT {keys}, mean, se, CASE WHEN mean - 1.96 * se < 0 THEN 0 ELSE mean - 1.96 * se END AS lci, mean + 1.96 * se AS uci FROM (
  SELECT {keys}, {div('1', 'av')} AS mean, {div('1', 'sd')} / sqrt(n) AS se FROM (
    SELECT {keys}, AVG(value) AS av, CASE WHEN NOT bool_or(isinf(value)) THEN
           stddev_samp(CASE WHEN NOT isinf(value) THEN value END) END AS sd, COUNT(*) AS n FROM chart GROUP BY {keys}))"""


points("d10", "species_code, ess, type, ss")
points("d11", "year, species_code, ess, type")

# ---- the queries ---------------------------------------------------------------------------

_cells = "year, species_code, length, males, females, unsexed"
_cells_st = f"{K}, length, males, females, unsexed"
_sum = "coalesce(CAST(abund AS DOUBLE), 0) AS abund"
_stats = f"{r('mean', 4)}, {r('se', 4)}, {r('lci', 4)}, {r('uci', 4)}, id"
_sides = f"{r('og', 4)}, {r('s20', 4)}, {r('diff', 4)}, {r('pd', 4)}"
_range = f"{r('mean')}, {r('se')}, {r('lci')}, {r('uci')}"
_ess = f"sim, year, species_code, ess, {single('value')}, in_out"
_ageout = f"{r('unsexed', 4)}, {r('males', 4)}, {r('females', 4)}"

FINAL: dict[str, str] = {
    "s1_read_strata": f"SELECT stratum, area FROM fx_strata WHERE survey = '{SURVEY}'",
    "s2_read_lfreq": f"""SELECT {KH}, sex, length, frequency FROM fx_lfreq WHERE survey = '{SURVEY}'
        AND stratum IN (SELECT stratum FROM fx_strata WHERE survey = '{SURVEY}')""",
    "s2_rejects": """SELECT *, concat_ws('; ', CASE WHEN length = '1OO' THEN 'length: 1OO' END, CASE frequency WHEN 'several' THEN
        'frequency: several' WHEN 'NA' THEN 'frequency: missing' END) AS reasons FROM fx_mistyped WHERE length = '1OO' OR frequency IN ('several', 'NA')""",
    "s2_checked": f"SELECT {KH}, sex, length, frequency FROM fx_lfreq WHERE length <> 100 AND sex <> 3",
    "s3_read_cpue": f"""SELECT year, species_code, catchjoin, hauljoin, stratum, numcpue, t.area FROM fx_cpue c
        LEFT JOIN (SELECT stratum, area FROM fx_strata WHERE survey = '{SURVEY}') t USING (stratum) WHERE survey = '{SURVEY}'""",
    "s4_read_sizepop": f"""SELECT year, species_code, length, CAST(SUM(frequency) AS BIGINT) AS population
        FROM fx_lfreq WHERE survey = '{SURVEY}' GROUP BY year, species_code, length""",
    "s5_read_specimen": f"""SELECT {KH}, sex, length, age FROM fx_specimen WHERE region = '{SURVEY}' AND age IS NOT NULL
        AND stratum IN (SELECT stratum FROM fx_strata WHERE survey = '{SURVEY}')""",
    "s6_normalise_ebs": """SELECT species_code, l.hauljoin, sex, length, frequency, year * 100 + 1 AS cruise, year, h.stratum
        FROM fx_lfreq l JOIN (SELECT DISTINCT hauljoin, stratum FROM fx_cpue) h USING (hauljoin)""",
    "s7_normalise_ebs_cpue": """SELECT year, species_code, catchjoin, hauljoin, stratum, numcpue AS ncpue, area AS effort,
        numcpue, area FROM fx_cpue""",
    "s8_write_result": f"SELECT 1 AS sim, {_cells} FROM og_size",
    "s9_read_result": f"SELECT 1 AS sim, {_cells_st} FROM og_size_st",
    "p1_length_grid": "SELECT year, species_code, length FROM grid",
    "p1_length_grid_strata": f"SELECT {K}, length FROM grid_st",
    "p2_since": f"SELECT {KH}, sex, length, frequency FROM lf",
    "p3_uncount": f"SELECT {KH}, sex, length, CAST(o AS BIGINT) AS ordinal FROM lf_all, UNNEST(range(1, frequency + 1)) AS u(o)",
    "p4_split_sexed": f"SELECT {KH}, sex, length, id, n FROM fish_all",
    "p5_subsample": f"""SELECT sim, {KH}, sex, length, id, n, CAST(least(n, ss) AS BIGINT) AS new_samp
        FROM sa_rank WHERE rk <= ss""",
    "p6_newly_unsexed": f"SELECT sim, {KH}, 3 AS sex, length, id, n FROM sa_rank WHERE rk > ss",
    "p7_retabulate": f"SELECT sim, {KH}, sex, length, frequency FROM sa_freq",
    "p8_haul_count": f"SELECT {K}, nhauls FROM al_nh",
    "p9_length_comp": f"SELECT {KH}, sex, length, {r('comp')}, nhauls FROM al_comp",
    "p10_stratum_comp": f"SELECT {K}, sex, length, {r('comp')} FROM al_unk",
    "p11_hauls_without_lengths": f"SELECT {KH}, catchjoin, numcpue, area FROM al_nolen",
    "p12_haul_abundance": f"SELECT {KH}, {r('abund')} FROM pop_all",
    "p13_impute_comp": f"SELECT {KH}, sex, length, {r('comp')} FROM al_imp",
    "p14_expand": f"SELECT {KH}, sex, length, {r('comp')}, {r('abund')}, sz_pop FROM al_exp",
    "p15_size_sum": f"SELECT year, species_code, length, sex, {_sum} FROM al_size_sum",
    "p15_size_sum_strata": f"SELECT {K}, length, sex, {_sum} FROM al_size_st_sum",
    "p16_sexes_wide": f"SELECT {_cells} FROM al_size_wide",
    "p17_fill_grid": f"SELECT {_cells_st} FROM al_size_st",
    "p18_pop_est": f"SELECT {_cells} FROM og_size",
    "p18_pop_est_strata": f"SELECT {_cells_st} FROM og_size_st",
    "p18_pop_est_sampled": f"SELECT {_cells} FROM s1_size",
    "p18_pop_est_sampled_strata": f"SELECT {_cells_st} FROM s1_size_st",
    "c1_simulate": f"SELECT sim, {_cells} FROM sim_size",
    "c1_simulate_strata": f"SELECT sim, {_cells_st} FROM sim_size_st",
    "c1_simulate_both": f"SELECT sim, {_cells_st} FROM sim_size_st UNION ALL BY NAME SELECT sim, {_cells} FROM sim_size",
    "c5_sweep_both": f"SELECT ss, sim, {_cells_st} FROM swp_size_st UNION ALL BY NAME SELECT ss, sim, {_cells} FROM swp_size",
    "c4_one_draw_size": f"SELECT sim, {_cells} FROM sim_size",
    "c4_one_draw_removed": f"SELECT sim, {KH}, 3 AS sex, length, id, n FROM sim_rank WHERE rk > ss",
    "c3_removed_counted": f"""SELECT {KH}, round(COUNT(*) / {SIMS}.0::DOUBLE, 6) AS ss_removed
        FROM sim_rank WHERE rk > ss GROUP BY {KH}""",
    "p13_abundance_histogram": f"""SELECT {K}, {r('abund')}, COUNT(*) AS catch_rows
        FROM (SELECT {KH}, catchjoin FROM al_nolen) LEFT JOIN (SELECT DISTINCT {KH}, abund FROM pop_all) USING ({KH}) GROUP BY ALL""",
    "c2_removed": f"SELECT sim, {KH}, 3 AS sex, length, id, n FROM sim_rank WHERE rk > ss",
    "c3_removed_summary": f"""SELECT {KH}, round(COUNT(*) / {SIMS}.0::DOUBLE, 6) AS ss_removed
        FROM sim_rank WHERE rk > ss GROUP BY {KH}""",
    "c4_sims_saved": f"""SELECT {KH}, round(COUNT(*) / {SIMS}.0::DOUBLE, 6) AS ss_removed
        FROM sim_rank WHERE rk > ss GROUP BY {KH}""",
    "c5_sweep": f"SELECT ss, sim, {_cells} FROM swp_size",
    "c6_sweep_iters": f"SELECT run, sim, {_cells} FROM itr_size",
    "c7a_bootstrap_hauls": f"SELECT sim, {KH}, ordinal, sex, length, frequency FROM b{SAMPLES}_h",
    "c7_bootstrap": f"SELECT sim, {KH}, ordinal, sex, length, frequency FROM b{SAMPLES}_rows",
    "c7b_bootstrap_lengths": f"SELECT sim, {KH}, ordinal, sex, length, frequency FROM b{SAMPLES}_rows",
    "c8_pop_est_boot": f"SELECT sim, {_cells} FROM b{SAMPLES}_size",
    "c9_sims_boot": f"SELECT {_ess} FROM b{SAMPLES}_ess",
    "c10_label_scenarios": f"SELECT {_ess}, type, ss FROM scen",
    "d1_sexes_long": " UNION ALL ".join(
        f"SELECT year, species_code, length, '{c}' AS name, {c} AS value FROM og_size" for c in ("males", "females", "unsexed")
    ),
    "d2_bin_summary": f"SELECT year, species_code, name, length, {_stats} FROM d2",
    "d2_bin_summary_strata": f"SELECT {K}, name, length, {_stats} FROM d2_st",
    "d2_bin_summary_sweep": f"SELECT ss, year, species_code, name, length, {_stats} FROM d2_swp",
    "d4_compare_sweep": f"SELECT ss, year, species_code, name, {_sides} FROM d4_swp",
    "d3_only": f"SELECT {_cells} FROM og_size WHERE species_code IN (10110, 10120) AND year IN (1998, 1999)",
    "d4_compare": f"SELECT year, species_code, name, {_sides} FROM d4",
    "d4_compare_strata": f"SELECT {K}, name, {_sides} FROM d4_st",
    "d5_ribbon_frame": f"""SELECT year, species_code, name, length, {_stats} FROM
        (SELECT * FROM d2_og UNION ALL BY NAME SELECT * FROM d2)""",
    "d6_density_frame": f"SELECT species_code, name, data, point, {r('x')}, {r('density')} FROM d6",
    "d7_diff_density": f"SELECT stratum, point, {r('x')}, {r('density')} FROM d7",
    "d8_rank_index": """SELECT *, CAST(coalesce(SUM(copies) OVER (PARTITION BY species_code ORDER BY length ROWS BETWEEN UNBOUNDED PRECEDING AND
        1 PRECEDING), 0) AS BIGINT) AS below, CAST(SUM(copies) OVER (PARTITION BY species_code) AS BIGINT) AS n
        FROM (SELECT species_code, length, COUNT(*) AS copies FROM lf_all GROUP BY ALL)""",
    "d8_box_frame": f"""SELECT {_box}, max(n) AS n, {r('min(CASE WHEN inside THEN x END)', name='ymin')},
        {r('max(lower)', name='lower')}, {r('max(middle)', name='middle')}, {r('max(upper)', name='upper')},
        {r('max(CASE WHEN inside THEN x END)', name='ymax')}, COUNT(*) FILTER (NOT inside) AS outliers FROM boxed GROUP BY {_box}""",
    "d8_box_outliers": f"SELECT sim, year, species_code, ess, in_out, type, ss, {r('x')} FROM boxed WHERE NOT inside",
    "d9_violin_frame": f"""SELECT {_box}, point, {r('x')}, {single('density')}, {r('middle', name='median')}
        FROM d9 JOIN boxes USING ({_box})""",
    "d10_point_range": f"SELECT species_code, ess, type, ss, {_range} FROM d10",
    "d10_point_range_chart": f"SELECT species_code, ess, type, ss, {_range} FROM d10 WHERE species_code IN (21921, 10110, 21720)",
    "d11_point_range_by_year": f"SELECT year, species_code, ess, type, {_range} FROM d11",
    "e1_proportions": f"SELECT {K}, length, {r('og_m')}, {r('og_f')}, {r('og_t')} FROM e3_q",
    "e2_ess_size": f"SELECT {_ess} FROM e2",
    "e3_ess_size_strata": f"SELECT sim, {K}, ess, {single('value')}, in_out FROM e3",
    "e4_ess_age": f"SELECT sim, year, species_code, ess, {single('value')} FROM e4",
    "e6_in_out": "SELECT sim, year, species_code, ess, in_out FROM e6",
    "e7_prop_fm": f"SELECT sim, year, species_code, {r('prop_fm')}, {r('prop_fm_og')} FROM e7",
    "e8_prop_fm_strata": f"""SELECT sim, {K}, round(CASE WHEN NOT isinf(prop_fm) THEN prop_fm END, 6) AS prop_fm,
        round(CASE WHEN NOT isinf(prop_fm_og) THEN prop_fm_og END, 6) AS prop_fm_og FROM e8""",
    "a1_sizepop_long": "SELECT year, species_code, length, sex, sizepop FROM og_long",
    "a2_age_length_key": f"SELECT year, species_code, sex, length, age, {r('age_frac')} FROM akey_all",
    "a3_sexed_age_pop": f"SELECT year, species_code, sex, age, {r('agepop', 4)} FROM a3",
    "a4_unsexed_years": "SELECT year, species_code FROM unsexed_yr_all",
    "a5_pooled_key": f"SELECT year, species_code, length, age, {r('age_frac')} FROM pkey_all",
    "a6_unsexed_age_pop": f"SELECT year, species_code, sex, age, {r('agepop', 4)} FROM a6",
    "a7_ages_wide": f"SELECT year, species_code, age, {_ageout} FROM og_age",
    "a8_age_pop_est": f"SELECT year, species_code, age, {_ageout} FROM og_age",
    "a8_age_pop_est_sim": f"SELECT sim, year, species_code, age, {_ageout} FROM sim_age",
}


def oracle_sql() -> dict[str, str]:
    return {name: statement(final) for name, final in FINAL.items()}
