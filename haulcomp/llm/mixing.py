"""Mixing sources to target weights, with DataFrame functions only.

Leaves are domain / language / source. A leaf can give its tokens ``epochs`` times over. Weights are
normalised among siblings; a node's budget goes to its children by weight, and what a child can't
give (its subtree's capacity) is taken over by its siblings, again by weight, before the parent falls
short. Capacities are added up from the leaves, so a shortage reaches an ancestor only when
all siblings are exhausted. With siblings ordered by capacity / weight the level at which they fill
up has a closed form, so one window per level of the tree settles it.

A leaf's budget is met by whole epochs and then a token-prefix of one more, in the order of a seeded hash
of (epoch, document). A document is in the prefix when the tokens before it are fewer than what is left,
so a leaf passes its budget by less than one document. Prefix sums are taken over hash slices of a leaf
first (2 ** ``SLICE_BITS`` of them) and within the one slice where the budget ends, so no task holds a leaf.

Null texts and texts without words have no tokens and are never chosen. Null domain, language or source
is a value like any other. Sources without a weight get ``other``. Repeated rows are separate documents
that share a hash; ties are ordered by id and text hash, equal rows may go either way but are equal. An
empty table gives an empty result. Extra columns are carried; those named like an output give way to it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulcomp.functions.draw import draw_bits
from haulcomp.llm import common as C

SEED = 42
#: Bits of the order's key, and of them those that cut a leaf into slices.
KEY_BITS, SLICE_BITS = 60, 12
LEVELS = ("domain", "lang", "source")
#: The query's target weights by level; whatever isn't named weighs ``OTHER``.
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"web": 0.6, "books": 0.25, "code": 0.15},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "source": {"src0": 2.0},
}
OTHER = 1.0
FRACTION, EPOCHS = 0.5, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def domain_of(source: Column) -> Column:
    """The test tables name no domain: sources are dealt to three by the remainder of their number."""
    number = F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(0)) % 3
    return F.when(number == 0, "web").when(number == 1, "books").otherwise("code")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]], other: float) -> Column:
    out = F.lit(float(other))
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def _share(nodes: DataFrame, path: Sequence[str], budget: Column) -> DataFrame:
    """Each node's ``budget``: its weight's part of the parent's, no more than ``cap``, the rest to its siblings."""
    parent = path[:-1]
    same = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf")))
    nodes = nodes.withColumns({"_b": F.least(budget, F.sum("cap").over(same)), "_r": ratio})
    before = same.orderBy("_r", *path).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_w = F.sum("w").over(same) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = F.when(left_w > 0, (F.col("_b") - filled) / left_w)
    nodes = nodes.withColumn("_level", level)
    # The water level: of those that leave their child within its capacity, the first in this order, and the largest.
    reached = F.max(F.when(F.col("_level") <= F.col("_r"), F.col("_level"))).over(same)
    got = F.when(reached.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * reached))
    return nodes.withColumn("budget", F.greatest(got, F.lit(0.0))).drop("_b", "_r", "_level")


def budgets(
    leaves: DataFrame, fraction: float, epochs: int, weights: Mapping[str, Mapping[str, float]], other: float = OTHER
) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with their ``budget`` of tokens.

    One row per leaf, so the sizes here are the number of sources, not of documents.
    """
    up = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("double"))
    total = Window.partitionBy(F.lit(0))
    up = up.withColumn("_top", F.sum("tokens").over(total) * F.lit(float(fraction)))
    given = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = up.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max("_top").alias("_top"))
        nodes = nodes.withColumn("w", _weight(level, weights, other))
        if given is not None:
            nodes = _with_leaf(nodes.drop("_top"), given, ["_top"])
        given = _share(nodes, path, F.col("_top")).select(*path, F.col("budget").alias("_top"))
    return _with_leaf(leaves, given, ["_top"]).withColumnRenamed("_top", "budget")


def choose(
    rows: DataFrame,
    fraction: float = FRACTION,
    epochs: int = EPOCHS,
    weights: Mapping[str, Mapping[str, float]] = WEIGHTS,
    seed: int = SEED,
) -> DataFrame:
    """The chosen rows of a ``measured`` table with ``copies``, how often each is taken."""
    rows = rows.filter(F.col("n_tokens") > 0)
    sums = C.stage(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    plan = budgets(sums, fraction, epochs, weights)
    full = F.floor(F.col("budget") / F.col("tokens")).cast("int")
    plan = C.stage(plan.withColumns({"full": full, "rest": F.col("budget") - full * F.col("tokens")}), "mix-plan")

    def placed(table: DataFrame, cols: Sequence[str]) -> DataFrame:
        # The epoch that is cut short has its own order.
        joined = _with_leaf(rows, table, cols).withColumn("_key", _order(seed))
        return joined.withColumn("_slice", F.shiftright("_key", KEY_BITS - SLICE_BITS))

    by_slice = placed(plan, ["full", "rest"]).groupBy(*LEVELS, "_slice").agg(F.sum("n_tokens").alias("_in"), F.max("rest").alias("rest"))
    leaf = Window.partitionBy(*LEVELS).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.withColumn("_before", F.coalesce(F.sum("_in").over(leaf), F.lit(0)))
    # The one slice per leaf in which the budget ends; a leaf with no rest has none.
    cut = by_slice.filter((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_in") >= F.col("rest")))
    cut = cut.select(*LEVELS, F.col("_slice").alias("_cut"), "_before")
    cut = C.stage(_with_leaf(plan, cut, ["_cut", "_before"], "left"), "mix-cut")
    marked = placed(cut, ["full", "rest", "_cut", "_before"])
    at_cut = F.coalesce(F.col("_slice") == F.col("_cut"), F.lit(False))
    within = Window.partitionBy(*LEVELS, "_slice").orderBy("_key", "doc_id", "_tie")
    ahead = F.coalesce(F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = marked.filter(at_cut).withColumn("_extra", F.col("_before") + ahead < F.col("rest"))
    outside = marked.filter(~at_cut).withColumn("_extra", F.coalesce(F.col("_slice") < F.col("_cut"), F.lit(False)))
    both = inside.unionByName(outside).withColumn("copies", F.col("full") + F.col("_extra").cast("int"))
    return both.filter(F.col("copies") > 0).drop("full", "rest", "_cut", "_before", "_key", "_slice", "_extra")


def _order(seed: int) -> Column:
    """Place of a row in the order of its leaf's last epoch."""
    return draw_bits(seed, "mix", F.col("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _with_leaf(rows: DataFrame, table: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the levels that ``table`` has, null being a value; one row per node on the right."""
    on = [c for c in LEVELS if c in table.columns]
    right = table.select(*[F.col(c).alias(f"_r_{c}") for c in on], *cols)
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return rows.join(right, same, how).drop(*[f"_r_{c}" for c in on])


def measured(docs: DataFrame, *carry: Column) -> DataFrame:
    """What choosing works on: leaf, id, tokens and a hash that tells rows with one id apart."""
    return docs.select(
        docs["doc_id"],
        domain_of(docs["source"]).alias("domain"),
        docs["lang"],
        docs["source"],
        word_count(docs["text"]).alias("n_tokens"),
        F.md5(docs["text"]).alias("_tie"),
        *carry,
    )


def mixed(docs: DataFrame, fraction: float = FRACTION, epochs: int = EPOCHS, weights=WEIGHTS) -> DataFrame:
    """The chosen documents with their own columns, each as often as it is taken.

    Rows carry their text past the joins with the small plan; only those of the slices where a budget ends are moved.
    """
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")
    taken = choose(measured(docs, whole), fraction, epochs, weights)
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = C.stage(measured(C.table(spark, sf_dir, "documents")), "mix-docs")
    return choose(narrow).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def sql() -> str:
    """The query in DuckDB's SQL: windows over whole leaves."""

    def same(a: str, b: str, path: Sequence[str]) -> str:
        return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in path)

    def weight(level: str) -> str:
        return f"CASE {' '.join(f"WHEN {level} = '{v}' THEN {float(w)}" for v, w in WEIGHTS[level].items())} ELSE {OTHER} END"

    steps = [
        r"""d AS (SELECT doc_id, CASE coalesce(try_cast(regexp_extract(source, '(\d+)$', 1) AS INTEGER), 0) % 3
                         WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain, lang, source,
                  CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, md5(text) AS tie
              FROM documents)""",
        "r AS (SELECT * FROM d WHERE n_tokens > 0)",
        "leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM r GROUP BY ALL)",
        f"g AS (SELECT CAST(sum(tokens) AS DOUBLE) * {FRACTION} AS budget FROM leaves)",
    ]
    above = "g"
    for depth, level in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        names, part = ", ".join(path), f"PARTITION BY {', '.join(path[:-1])}" if depth else ""
        on = f"JOIN {above} a ON {same('a', 'n', path[:-1])}" if depth else "CROSS JOIN g a"
        before = f"OVER ({part} ORDER BY r, {names} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        steps += [
            f"n{depth} AS (SELECT {names}, CAST(sum(tokens) * {EPOCHS} AS DOUBLE) AS cap, {weight(level)} AS w FROM leaves GROUP BY {names})",
            f"p{depth} AS (SELECT n.*, CASE WHEN w > 0 THEN cap / w ELSE CAST('Infinity' AS DOUBLE) END AS r, a.budget AS given FROM n{depth} n {on})",
            f"""l{depth} AS (SELECT *, (least(given, sum(cap) OVER ({part})) - coalesce(sum(cap) {before}, 0))
                        / nullif(greatest(sum(w) OVER ({part}) - coalesce(sum(w) {before}, 0), 0), 0) AS level FROM p{depth})""",
            f"m{depth} AS (SELECT *, max(CASE WHEN level <= r THEN level END) OVER ({part}) AS reached FROM l{depth})",
            f"b{depth} AS (SELECT {names}, CASE WHEN reached IS NULL THEN cap ELSE greatest(least(cap, w * reached), 0) END AS budget FROM m{depth})",
        ]
        above = f"b{depth}"
    steps += [
        f"plan AS (SELECT l.*, CAST(floor(b.budget / l.tokens) AS INTEGER) AS f, b.budget FROM leaves l JOIN b2 b ON {same('l', 'b', LEVELS)})",
        f"""k AS (SELECT r.*, f, budget - f * p.tokens AS rest,
                  CAST('0x' || substr(md5(concat_ws('|', {SEED}, 'mix', f, coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 15) AS BIGINT) AS key
              FROM r JOIN plan p ON {same('r', 'p', LEVELS)})""",
        """c AS (SELECT *, f + CASE WHEN coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, tie
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest THEN 1 ELSE 0 END AS copies FROM k)""",
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, domain, lang, source, n_tokens, CAST(copies AS INTEGER) AS copies FROM c WHERE copies > 0"
