"""Quality rules: a base rule and gradient-boosted trees over document statistics.

The statistics are taken in one pass over the bytes of a batch. The trees are fitted on the driver
from a bounded sample of labelled documents (``SAMPLE`` rows, lowest hashes of the id), with histogram
splits and monotonic constraints: more symbols, duplicate lines or repeated windows never raise a
score. Fitted trees are flattened to node arrays, and a batch walks all of them level by level.

Null or empty texts have zero everywhere and fail the base rule. Rows are independent: repeated rows,
ties and extra columns pass through; an input column named like an output column gives way to it.
Without labels of both classes there are no trees, and the base rule alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcomp.llm import common as C

#: At most so many labelled documents are used to fit the trees.
SAMPLE = 20_000
ROUNDS, DEPTH, BINS, RATE, L2, LEAF = 60, 4, 64, 0.2, 1.0, 20
#: A document is rejected when the odds of being good fall below this.
CUT = 0.5
#: The symbols that count, and the base rule.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LEAST_WORDS, MOST_REPEATED = 50, 50

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
MORE = "n_bytes bigint, n_lines bigint, n_digits bigint, n_upper bigint, n_ends bigint, n_distinct bigint"
#: Features and the direction a score may move with them: 1 up, -1 down, 0 any.
FEATURES = {
    "words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeated": -1, "digits": 0, "upper": 0,
    "line_words": 0, "ends": 0, "distinct": 0,
}


def _copies(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does another equal one exist, and does an equal one stand earlier."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = sorted_key[1:] == sorted_key[:-1]
    any_copy = same.copy()
    any_copy[:-1] |= same[1:]
    has, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    has[order], later[order] = any_copy, same
    return has, later


def statistics(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """All statistics of the documents of a slice, exact but for collisions of 64-bit hashes."""
    n = len(off) - 1
    starts, ends, first = C.words(buf, off)
    n_words = np.diff(first)
    sums = C.prefix_sums(buf)
    doc = np.repeat(np.arange(n), n_words)
    salt = C.mix(np.arange(1, n + 1).astype(C.U))

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    hashes = C.span_hash(sums, starts, ends)
    repeated = np.zeros(len(starts), bool)
    grams = C.gram_hash(hashes, 3)
    if len(grams):
        inside = doc[2:] == doc[:-2]
        has, _ = _copies(C.mix(grams[inside] ^ salt[doc[2:][inside]]))
        at = np.flatnonzero(inside)[has]
        for i in range(3):
            repeated[at + i] = True
    _, again = _copies(C.mix(hashes ^ salt[doc]))

    # Lines: cut at newlines and document borders; those with a word count.
    is_newline = buf == 10
    line_starts = np.unique(np.concatenate([off[:-1], np.flatnonzero(is_newline) + 1]))
    line_starts = line_starts[line_starts < len(buf)] if len(buf) else np.zeros(0, np.int64)
    line_ends = np.concatenate([line_starts[1:], [len(buf)]]) if len(line_starts) else line_starts
    line_ends = line_ends - (is_newline[line_ends - 1] if len(buf) else 0)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_doc = np.searchsorted(off, line_starts, "right") - 1
    _, dup = _copies(C.mix(C.span_hash(sums, line_starts, line_ends) ^ salt[line_doc]))
    last = buf[ends[np.searchsorted(ends, line_ends, "right") - 1] - 1] if len(line_ends) else np.zeros(0, np.uint8)

    count = lambda of, flags: np.bincount(of, flags, n).astype(np.int64)
    return {
        "n_words": n_words,
        "word_chars": per_doc(~C.SPACE[buf] & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_doc(SYMBOLS[buf]),
        "n_dup_lines": count(line_doc, dup),
        "n_repeat_words": count(doc, repeated),
        "n_bytes": np.diff(off),
        "n_lines": count(line_doc, np.ones(len(line_doc))),
        "n_digits": per_doc((buf >= 48) & (buf <= 57)),
        "n_upper": per_doc((buf >= 65) & (buf <= 90)),
        "n_ends": count(line_doc, np.isin(last, list(b".!?"))),
        "n_distinct": count(doc, ~again),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES per document."""
    some = lambda x: np.maximum(x, 1)
    words, lines, size = some(s["n_words"]), some(s["n_lines"]), some(s["n_bytes"])
    return np.column_stack(
        [
            s["n_words"], s["word_chars"] / words, s["n_symbols"] / size, s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words, s["n_digits"] / size, s["n_upper"] / words, s["n_words"] / lines,
            s["n_ends"] / lines, s["n_distinct"] / np.sqrt(words),
        ]
    ).astype(np.float64)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row: rows x trees step down together."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees | None:
    """Boosted trees for the log odds of ``y``; None without both classes."""
    if not len(y) or y.min() == y.max():
        return None
    signs = list(FEATURES.values())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), start)
    nodes: list[list] = []
    roots = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def grow(rows: np.ndarray, depth: int, lo: float, hi: float) -> int:
            me = len(nodes)
            weight = float(np.clip(-g[rows].sum() / (h[rows].sum() + L2), lo, hi))
            nodes.append([0, np.inf, me, me, RATE * weight])
            best = _split(bins, cuts, g, h, rows, signs, lo, hi) if depth < DEPTH and len(rows) >= 2 * LEAF else None
            if best is None:
                raw[rows] += RATE * weight
                return me
            f, cut, wl, wr = best
            low = bins[rows, f] <= cut
            mid = (wl + wr) / 2
            bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[signs[f]]
            nodes[me][:2] = [f, float(cuts[f][cut])]
            nodes[me][2] = grow(rows[low], depth + 1, *bounds[0])
            nodes[me][3] = grow(rows[~low], depth + 1, *bounds[1])
            return me

        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    f, t, left, right, v = zip(*nodes)
    return Trees(np.array(f), np.array(t), np.array(left), np.array(right), np.array(v), np.array(roots), start)


def _split(bins, cuts, g, h, rows, signs, lo, hi):
    """(feature, bin, left weight, right weight) with the largest gain that keeps the constraints, or None."""
    best, gain = None, 1e-6
    total_g, total_h, n = g[rows].sum(), h[rows].sum(), len(rows)
    parent = total_g**2 / (total_h + L2)
    for f, sign in enumerate(signs):
        if not len(cuts[f]):
            continue
        b, size = bins[rows, f], len(cuts[f]) + 1
        gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], np.ones(n)))
        wl, wr = (np.clip(-a / (c + L2), lo, hi) for a, c in ((gl, hl), (total_g - gl, total_h - hl)))
        won = gl**2 / (hl + L2) + (total_g - gl) ** 2 / (total_h - hl + L2) - parent
        won[(nl < LEAF) | (n - nl < LEAF) | (sign * (wr - wl) < 0)] = -np.inf
        at = int(np.argmax(won))
        if won[at] > gain:
            best, gain = (f, at, float(wl[at]), float(wr[at])), won[at]
    return best


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Statistics and label of at most ``rows`` labelled documents, those with the lowest hashes."""
    known = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("_y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The bound on the broadcast side is ``rows``.
    text = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return C.with_text_columns(text, ["doc_id", "_y"], statistics, f"{BASE}, {MORE}")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Trees | None:
    """Trees from the bounded sample; documents that the base rule rejects teach nothing."""
    got = sample(docs, labels, rows).toPandas().sort_values(["doc_id", "n_bytes"], kind="stable")
    s = {c: got[c].to_numpy() for c in got.columns}
    use = ~base_failed(s)
    s = {c: v[use] for c, v in s.items()}
    return fit(features(s), s["_y"].astype(float)) if len(s["_y"]) else None


def judge(docs: DataFrame, trees: Trees | None, keep: list[str]) -> DataFrame:
    """``keep`` columns with the statistics, base_failed, the trees' score (null without trees) and the verdict kept."""

    def compute(buf, off):
        s = statistics(buf, off)
        failed = base_failed(s)
        score = trees.score(features(s)) if trees else np.full(len(failed), np.nan)
        kept = ~failed & ((score >= CUT) if trees else True)
        return s | {"base_failed": failed, "score": score, "kept": kept}

    return C.with_text_columns(docs, keep, compute, f"{BASE}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    trees = train(docs, labels)
    at = docs.columns.index("text")

    def run(it):
        for batch in it:
            flags = []
            for _, _, buf, off in C.text_slices(batch.column(at)):
                s = statistics(buf, off)
                ok = ~base_failed(s)
                flags.append(ok & (trees.score(features(s)) >= CUT) if trees else ok)
            if flags:
                yield batch.filter(pa.array(np.concatenate(flags)))

    return C.map_arrow(docs, run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    trees = train(docs, C.table(spark, sf_dir, "labels"))
    return judge(docs, trees, ["doc_id"])
