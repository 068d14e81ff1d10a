"""Benchmark decontamination: documents that hold a passage of a benchmark item, up to a few edits.

Texts are compared as UTF-8 bytes after lower-casing (all of Unicode) and making every run of white space one
space. Every ``WINDOW`` bytes of an item are a window (they start at every ``STRIDE``-th byte, which is each, and at
the last); a shorter item is one window. A document is a match when some part of it is within the window's edit budget
(``RATE`` of its length, rounded down) of the window.

By the q-gram lemma such a part shares at least length - Q + 1 - budget * Q of the window's q-grams, and
their diagonals (place in the document minus place in the item) differ by no more than the budget. So
shared q-grams are counted in overlapping diagonal bands, windows that reach the bound are kept (found from
the shared q-grams alone: as many as the bound within one window), and a banded alignment decides. Nothing within the budget is lost; nothing else is reported.

At most about ``PAIRS`` pairs of equal q-grams are held at once. A document that makes more (a periodic text and a periodic item make
one for each pair of places) is taken piece by piece, and items too; pieces overlap by what a window may reach, so
all q-grams that a window and its part share are in one pair of pieces. Items found before are skipped.

Null or empty texts, and items of fewer than ``Q`` bytes, match nothing. Items may have ids of any type, also null or repeated
ones. A document's result doesn't depend on other rows; repeated rows repeat it; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from haulcomp.llm import common as C

WINDOW, STRIDE, RATE, Q = 100, 1, 0.06, 12
#: Bytes of benchmark text that go to the tasks at once; more are taken in several passes.
BLOCK = 16 << 20
FILTER_BITS = 22
#: Pairs of equal q-grams that are held at once, and the places of a text or of the items in one piece of those that make more.
PAIRS, PIECE = 1_000_000, 1_000
#: Alignments whose result is remembered.
KNOWN = 10_000


def budget(length: int) -> int:
    """Edits allowed for a window, small enough for the lemma to give a bound of at least 1."""
    return max(0, min(int(RATE * length), (length - Q) // Q))


def normal(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with single spaces; a zero byte ends every document."""
    space = C.SPACE[buf]
    drop = np.zeros(len(buf), bool)
    drop[1:] = space[1:] & space[:-1]
    drop[off[:-1][off[:-1] < len(buf)]] = False
    low = np.where(space, np.uint8(32), buf)
    kept = np.concatenate([[0], np.cumsum(~drop)])
    n = len(off) - 1
    new_off = kept[off] + np.arange(n + 1)
    out = np.zeros(int(new_off[-1]), np.uint8)
    at = kept[:-1] + np.repeat(np.arange(n), np.diff(off))
    out[at[~drop]] = low[~drop]
    return out, new_off


def grams(buf: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes that start at each place."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, C.U)
    buf = np.ascontiguousarray(buf)
    a = np.ndarray(n, "<u8", buf, 0, (1,))
    b = np.ndarray(n, "<u4", buf, 8, (1,))
    h = a * C.U(C.BASE) + b.astype(C.U) * C.U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> C.U(29))


class Items:
    """Window lengths and q-grams of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None], kind: pa.DataType):
        raw = [x.encode() for x in pc.utf8_lower(pa.array([t or "" for t in texts], pa.string())).to_pylist()]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        text, self.off = normal(np.frombuffer(b"".join(raw), np.uint8), off)
        self.ids, self.text = pa.array(ids, kind), text
        h = grams(text)
        doc = np.searchsorted(self.off, np.arange(len(h)), "right") - 1
        inside = np.arange(len(h)) + Q <= self.off[doc + 1] - 1
        at = np.flatnonzero(inside)
        order = np.argsort(h[at], kind="stable")
        self.hash, self.place = h[at][order], at[order]
        # Number of the q-gram and place as one number, by which the places in a range are found.
        new = np.ones(len(order), np.int64)
        new[1:] = self.hash[1:] != self.hash[:-1]
        self.both = np.cumsum(new) * (len(text) + 1) + self.place
        self.known: dict[bytes, tuple[int, int, int] | None] = {}
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.hash)] = True
        # Of each item: window length, edit budget, least number of shared q-grams; an item of fewer than Q bytes has no q-gram.
        size = np.minimum(WINDOW, np.diff(self.off) - 1)
        edits = [budget(int(n)) for n in size]
        self.rules = [(int(n), k, int(n) - Q + 1 - k * Q) for n, k in zip(size, edits)]
        use = [r for r in self.rules if r[0] >= Q]
        self.least = min((bound for *_, bound in use), default=0)
        self.band = max((k for _, k, _ in use), default=0) + 1

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * C.U(0x9E3779B97F4A7C15)) >> C.U(64 - FILTER_BITS)).astype(np.int64)

    def _shared(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the text whose q-gram an item has, and for each the range of its places in ``place``."""
        h = grams(text)
        at = np.flatnonzero(self.filter[self._slot(h)])
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        return at[hi > lo], lo[hi > lo], hi[hi > lo]

    def matches(self, text: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, edits, place in the document) of each matching pair: its first window that aligns."""
        at, lo, hi = self._shared(text)
        found: set[tuple[int, int]] = set()
        if (hi - lo).sum() <= PAIRS:
            yield from self._matches(text, off, at, lo, hi, found)
            return
        doc = np.searchsorted(off, at, "right") - 1
        pairs = np.bincount(doc, hi - lo, len(off) - 1)
        first = 0
        while first < len(pairs):
            # As many documents as stay within the limit, or one.
            last = max(first + 1, first + int(np.searchsorted(np.cumsum(pairs[first:]), PAIRS, "right")))
            some = slice(*np.searchsorted(doc, [first, last]))
            if pairs[first] <= PAIRS:
                yield from self._matches(text, off, at[some], lo[some], hi[some], found)
            else:
                yield from self._by_pieces(text, off, at[some], lo[some], hi[some], first, found)
            first = last

    def _by_pieces(self, text, off, at, lo, hi, doc: int, found: set[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """``matches`` of one document, by pieces of it and of the items."""
        reach = WINDOW + self.band + Q
        row = len(self.text) + 1
        for start in range(int(off[doc]), int(off[doc + 1]), PIECE):
            here = slice(*np.searchsorted(at, [start, start + PIECE + reach]))
            if (hi[here] - lo[here]).sum() <= PAIRS:
                yield from self._matches(text, off, at[here], lo[here], hi[here], found)
                continue
            # Where the q-gram's places begin in ``both``.
            base = self.both[lo[here]] - self.place[lo[here]]
            for begin in range(0, len(self.text), PIECE):
                end = begin + PIECE + WINDOW
                items = range(int(np.searchsorted(self.off, begin, "right")) - 1, int(np.searchsorted(self.off, min(end, len(self.text)), "left")))
                if all((doc, i) in found for i in items):
                    continue
                low, high = np.searchsorted(self.both, base + begin), np.searchsorted(self.both, base + min(end, row - 1))
                some = high > low
                if some.any():
                    yield from self._matches(text, off, at[here][some], low[some], high[some], found)

    def _matches(self, text, off, at, lo, hi, found: set[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """``matches`` from the pairs of places given, less those in ``found``, which grows."""
        n = hi - lo
        j = np.repeat(at, n)
        i = self.place[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        doc = np.searchsorted(off, j, "right") - 1
        item = np.searchsorted(self.off, i, "right") - 1
        diag = j - i
        lane = diag // self.band
        if not len(j):
            return
        # Each hit counts in both bands that hold its diagonal; a q-gram of the item counts once in a band.
        doc, item, i, lane = (np.concatenate(x) for x in ((doc, doc), (item, item), (i, i), (lane, lane - 1)))
        order = np.lexsort((i, lane, item, doc))
        doc, item, lane, i = doc[order], item[order], lane[order], i[order]
        change = np.ones(len(i), bool)
        change[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lane[1:] != lane[:-1])
        new = change.copy()
        new[1:] |= i[1:] != i[:-1]
        doc, item, lane, i, change = doc[new], item[new], lane[new], i[new], change[new]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(i))
        for s, e in zip(starts[ends - starts >= self.least], ends[ends - starts >= self.least]):
            d, it, ln = int(doc[s]), int(item[s]), int(lane[s])
            if (d, it) in found:
                continue
            length, k, bound = self.rules[it]
            at = self.reaching(i[s:e], it)
            # The first window alone, then more at once.
            for few in np.split(at, [n for n in (1, 9, *range(73, len(at), 64)) if n < len(at)]):
                if not len(few):
                    break
                lo = np.maximum(int(off[d]), few + ln * self.band - k)
                hi = np.minimum(int(off[d + 1]) - 1, few + length + (ln + 2) * self.band + k)
                hit = self._aligned(few, length, k, text, lo, hi)
                if hit is not None:
                    found.add((d, it))
                    yield d, it, hit[1], int(lo[hit[0]]) + hit[2] - int(off[d])
                    break

    def _aligned(self, few, length: int, k: int, text, lo, hi) -> tuple[int, int, int] | None:
        """(number of the first window within the budget, edits, end of its part after its ``lo``); None if there is none.

        A periodic text asks for the same windows in the same bytes again and again, so answers are kept for a while.
        """
        least = int(lo.min())
        asked = b"|".join(x.tobytes() for x in (few, lo - least, hi - least, text[least : int(hi.max())]))
        if asked not in self.known:
            if len(self.known) > KNOWN:
                self.known.clear()
            edits, place = align(self.text[few[:, None] + np.arange(length)], text, lo, hi)
            good = np.flatnonzero(edits <= k)
            self.known[asked] = (int(good[0]), int(edits[good[0]]), int(place[good[0]])) if len(good) else None
        return self.known[asked]

    def reaching(self, shared: np.ndarray, item: int) -> np.ndarray:
        """Starts of the item's windows that hold at least the bound of the (sorted, distinct) places of shared q-grams."""
        length, _, bound = self.rules[item]
        lo, last = int(self.off[item]), int(self.off[item + 1]) - 1 - length
        if len(shared) < bound:
            return np.zeros(0, np.int64)
        low, high = shared[: len(shared) - bound + 1], shared[bound - 1 :]
        # Windows that hold both ends of ``bound`` places in a row begin in [high - (length - Q), low].
        begin, end = np.maximum(high - (length - Q), lo), np.minimum(low, last)
        n = np.maximum(end - begin + 1, 0)
        at = np.unique(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n))
        return at[((at - lo) % STRIDE == 0) | (at == last)]


def align(windows: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each whole window (a row) and any part of its region [lo, hi) of the text, and that part's end.

    The regions are no wider than the band allows, so every row of a table is the band.
    """
    size = np.maximum(hi - lo, 0)
    width = np.arange(int(size.max(initial=0)) + 1)
    inside = width[:-1] < size[:, None]
    # What lies after a shorter region is a byte that no text holds.
    region = np.where(inside, text[np.minimum(lo[:, None] + width[:-1], len(text) - 1)], np.uint8(255))
    row = np.zeros((len(windows), len(width)), np.int64)
    for r in range(windows.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = r + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (region != windows[:, r, None]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - width, axis=1) + width
    row[width > size[:, None]] = windows.shape[1] + 1
    end = np.argmin(row, axis=1)
    return row[np.arange(len(row)), end], end


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of at most BLOCK bytes (or one item)."""
    ids, texts, size = [], [], 0
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    for row in benchmark.select("item_id", "text").toLocalIterator():
        more = len(row.text or "") * 4
        if ids and size + more > BLOCK:
            yield Items(ids, texts, kind)
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += more
    yield Items(ids, texts, kind)


def find_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document row and item that match: key, item_id, edits, at (the part's end in the normal text)."""
    key_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, key), (benchmark, "item_id")))
    schema = C.fields(f"_key {key_kind}, item_id {item_kind}, edits int, at bigint")
    source = docs.select(docs["text"].alias("_text"), docs[key].alias("_key"))
    parts = []
    for items in item_blocks(benchmark):

        def run(it, items=items):
            for batch in it:
                for lo, hi, buf, off in C.text_slices(pc.utf8_lower(batch.column(0))):
                    got = list(items.matches(*normal(buf, off)))
                    if got:
                        d, i, edits, at = (np.array(x) for x in zip(*got))
                        keys = batch.column(1).slice(lo, hi - lo).take(pa.array(d))
                        yield C.batches(schema, keys, items.ids.take(pa.array(i)), edits, at)

        parts.append(C.map_arrow(source, run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("_key", key)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, with their own columns."""
    at = docs.columns.index("text")
    for items in item_blocks(benchmark):

        def run(it, items=items):
            for batch in it:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, buf, off in C.text_slices(pc.utf8_lower(batch.column(at))):
                    keep[[lo + d for d, *_ in items.matches(*normal(buf, off))]] = False
                yield batch.filter(pa.array(keep))

        docs = C.map_arrow(docs, run, docs.schema)
    return docs


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
