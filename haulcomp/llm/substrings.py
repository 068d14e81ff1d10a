"""Exact removal of long repeated substrings, on bytes, over the whole corpus.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (smaller doc_id, or same document and
earlier start) is removed. Strings are judged on the input; overlaps count; nothing crosses documents.

1. The least hash of the ``GRAM``-grams in a string of LENGTH bytes is its key; equal strings have equal keys, and the
   strings that start one after another mostly share theirs. The places where a key is taken (about
   one in 35 bytes) are counted by key. Keys that occur once are dropped. Within a slice of documents repeats are
   known already and need no other task, so a key sends one row per slice to the count, however hot it is.
2. For the documents that have repeated keys, each run of starts with such a key gives a context: the bytes of all
   its strings. Contexts of equal bytes are settled by the first of them: within a task before they are moved, so that
   a context sends one row per ``GATHER`` bytes of contexts however hot it is, and again where they meet by key. A key with more than
   ``HOT`` places is split by string content, one string per context; such strings are settled by their bytes alone
   and don't reach the transform.
3. Different contexts are cut down to where hashes of strings occur again (which loses no repeat). Blocks of whole keys
   are put in one text, in order of their places. Its suffix order and Burrows-Wheeler transform are made, and
   boundaries between suffixes that differ in their first l + 1 bytes are derived from those of l by one backward
   step, for l = 1, 2, ... up to LENGTH: what has no boundary then shares LENGTH bytes. In each such interval
   all but the first place are repeats.
4. The covered spans of a document are joined to its text and cut out.

Null text is the empty text; texts shorter than LENGTH are kept. Rows with equal id and text are treated
alike (as one document); rows that share an id but not a text are ordered by a hash after the id, a missing id comes first.
An empty table stays empty. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulcomp.llm import common as C

#: GRAM is long enough that ordinary prose doesn't repeat it by chance; a multiple of 8.
LENGTH, GRAM = 100, 32
#: Places of a key beyond which its strings are dealt out one by one; bytes of a block; starts in one context.
HOT, BLOCK, RUN = 40_000, 256 << 10, 1024
#: Bytes of contexts that are compared with each other at once.
GATHER = 4 << 20
PLACE = [("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")]


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours, by doubling."""
    take, size = (np.minimum if least else np.maximum), 1
    while size * 2 <= width:
        x = take(x[:-size], x[size:])
        size *= 2
    if size < width:
        x = take(x[: len(x) - (width - size)], x[width - size :])
    return x


def keys_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, starts of the strings inside documents, their keys)."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, C.U), np.zeros(0, np.int64), np.zeros(0, C.U)
    buf = np.ascontiguousarray(buf)
    m = len(buf) - GRAM + 1
    h = np.zeros(m, C.U)
    for at in range(0, GRAM, 8):
        h = C.mix(h + np.ndarray(m, "<u8", buf, at, (1,)) * C.U(C.BASE))
    low = _sliding(h, LENGTH - GRAM + 1, True)
    room = np.repeat(off[1:], np.diff(off))[:n] - np.arange(n) >= LENGTH
    starts = np.flatnonzero(room)
    return h, starts, low[starts]


def key_places(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of every gram that is the key of some string."""
    h, starts, key = keys_of(buf, off)
    if not len(starts):
        return starts, key
    width = LENGTH - GRAM + 1
    own = np.zeros(len(h) + width - 1, C.U)
    own[starts + width - 1] = key
    place = np.flatnonzero((_sliding(own, width, False)[: len(h)] == h) & (h > 0))
    return place, h[place]


def _row_id():
    return F.xxhash64("doc_id", "text").alias("row")


def repeated_keys(docs: DataFrame) -> DataFrame:
    """(key, row): keys that occur at two or more places, with the rows that have them."""

    def run(it):
        from pyspark import TaskContext

        salt = (TaskContext.get().partitionId() + 1) << 24
        for batch in it:
            for lo, hi, buf, off in C.text_slices(batch.column(0)):
                salt += 1
                place, key = key_places(buf, off)
                row = batch.column(1).slice(lo, hi - lo).to_numpy()[np.searchsorted(off, place, "right") - 1]
                order = np.argsort(key, kind="stable")
                key, row = key[order], row[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                count = np.diff(np.append(np.flatnonzero(new), len(key)))
                many = np.repeat(count > 1, count)
                # One row per key for the count over all slices; repeats of this slice are settled among themselves.
                of = np.concatenate([key[new], key[many]]).view(np.int64)
                rows = np.concatenate([row[new], row[many]])
                salts = np.concatenate([np.zeros(int(new.sum()), np.int64), np.full(int(many.sum()), salt)])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(rows), pa.array(salts)], names=["key", "row", "salt"])

    rows = C.map_arrow(docs.select("text", _row_id()), run, "key bigint, row bigint, salt bigint")
    same = Window.partitionBy("key", "salt")
    return rows.withColumn("n", F.count(F.lit(1)).over(same)).filter("n > 1").select("key", "row")


def _merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of bytes with those of one row that touch or overlap made one."""
    if not len(row):
        return row, first, last
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order].astype(np.int64), last[order].astype(np.int64)
    # Rows are set apart, so that a running maximum stays within its row.
    apart = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])]) << 33
    reach = np.maximum.accumulate(last + apart)
    new = np.ones(len(row), bool)
    new[1:] = (first + apart)[1:] > reach[:-1]
    end = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
    return row[new], first[new], (reach - apart)[end]


def _again(held: pa.ChunkedArray) -> np.ndarray:
    """Which values have stood before, by their bytes."""
    code = held.combine_chunks().dictionary_encode()
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
    later = np.ones(len(code), bool)
    later[np.unique(code, return_index=True)[1]] = False
    return later


def _ends(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, byte after the last) of contexts."""
    row, start, n = (t.column(c).to_numpy() for c in ("row", "start", "n"))
    return row, start, start + n - 1 + LENGTH


def contexts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(key, doc_id, row, start, n, bytes): the runs of n starts with a repeated key.

    Contexts that stand earlier in the same task have no bytes; those of a row that touch are one, and their key is the row.
    """
    places = repeated.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT)
    flagged = repeated.join(places, "key", "left").select("row", F.struct("key", F.col("_n").isNotNull().alias("hot")).alias("_key"))
    per_row = flagged.groupBy("row").agg(F.sort_array(F.collect_set("_key")).alias("_keys"))
    packed = C.packed_texts(docs, docs["doc_id"], F.xxhash64(docs["doc_id"], docs["text"]).alias("row"))
    both = packed.join(per_row, "row").dropDuplicates(["row"]).select("z", "doc_id", "row", "_keys")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = C.fields(f"key bigint, doc_id {kind}, row bigint, start int, n int, bytes binary")

    def settled(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        t = t.take(pc.sort_indices(t, sort_keys=PLACE, null_placement="at_start"))
        again = _again(t.column("bytes"))
        yield from t.filter(pa.array(~again)).to_batches()
        row, first, last = _merged(*_ends(t.filter(pa.array(again))))
        ids = pa.nulls(len(row), t.schema.field("doc_id").type)
        yield C.batches(schema, row, ids, row, first.astype(np.int32), (last - first - LENGTH + 1).astype(np.int32), pa.nulls(len(row), pa.binary()))

    def run(it):
        held, size = [], 0
        for b in cut(it):
            held.append(b)
            size += b.column(5).nbytes
            if size >= GATHER:
                yield from settled(held)
                held, size = [], 0
        if held:
            yield from settled(held)

    def cut(it):
        for batch in it:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                wanted = b.column(3)
                flat = wanted.flatten()
                w_key, w_hot = flat.field("key").to_numpy().view(C.U), flat.field("hot").to_numpy(zero_copy_only=False)
                w_off = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy())])
                for lo, hi, buf, off in C.text_slices(C.blobs(C.unpacked(b.column(0)))):
                    _, starts, key = keys_of(buf, off)
                    if not len(starts):
                        continue
                    doc = np.searchsorted(off, starts, "right") - 1
                    new = np.ones(len(starts), bool)
                    new[1:] = (key[1:] != key[:-1]) | (np.diff(starts) != 1)
                    first = np.flatnonzero(new)
                    n = np.diff(np.append(first, len(starts)))
                    # Very long runs (periodic text) are cut; each part keeps its key.
                    parts = -(-n // RUN)
                    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    first, n = np.repeat(first, parts) + step * RUN, np.minimum(np.repeat(n, parts) - step * RUN, RUN)
                    s, k, d = starts[first], key[first], doc[first]
                    take, hot = np.zeros(len(s), bool), np.zeros(len(s), bool)
                    bounds = np.searchsorted(d, np.arange(len(off)))
                    for i in range(hi - lo):
                        x = k[bounds[i] : bounds[i + 1]]
                        own = slice(w_off[lo + i], w_off[lo + i + 1])
                        signed, order = w_key[own].view(np.int64), x.view(np.int64)
                        if len(signed) and len(order):
                            j = np.minimum(np.searchsorted(signed, order), len(signed) - 1)
                            take[bounds[i] : bounds[i + 1]] = signed[j] == order
                            hot[bounds[i] : bounds[i + 1]] = w_hot[own][j]
                    s, k, d, n, hot = s[take], k[take], d[take], n[take], hot[take]
                    if hot.any():
                        sums = C.prefix_sums(buf)
                        # One string per context, under a key of its own content.
                        m = n[hot]
                        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                        hs, hd, hk = np.repeat(s[hot], m) + inner, np.repeat(d[hot], m), np.repeat(k[hot], m)
                        hk = C.mix(hk ^ C.span_hash(sums, hs, hs + LENGTH))
                        s, d, k = np.concatenate([s[~hot], hs]), np.concatenate([d[~hot], hd]), np.concatenate([k[~hot], hk])
                        n = np.concatenate([n[~hot], np.ones(len(hs), np.int64)])
                    if len(s):
                        e = s + n - 1 + LENGTH
                        raw = buf.tobytes()
                        held = C.blobs([raw[x:y] for x, y in zip(s.tolist(), e.tolist())])
                        ids = [b.column(i).slice(lo, hi - lo).take(pa.array(d)) for i in (1, 2)]
                        yield C.batches(schema, k.view(np.int64), *ids, (s - off[d]).astype(np.int32), n.astype(np.int32), held)

    return C.map_arrow(both, run, schema)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all rotations of the text in order of (at least) their first ``depth`` bytes, by prefix doubling."""
    n = len(text)
    wrapped = np.concatenate([text, np.resize(text, 8)])
    key = np.ndarray(n, ">u8", wrapped, 0, (1,)).astype(C.U)
    done = 8
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if done >= depth or rank[order[-1]] == n - 1:
            return order.astype(np.int32)
        key = (rank.astype(C.U) << C.U(32)) | np.roll(rank, -done).astype(C.U)
        done *= 2


def equal_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Number of the interval of rotations that share ``length`` bytes, for each row of the order.

    Row r is the byte first[r] put before row back[r]. So rows r - 1 and r differ within l + 1 bytes when those bytes
    differ or their rows at ``back`` are parted within l; every round adds the boundaries with a
    common prefix of exactly l, and looks only at rows not parted yet.
    """
    transform = text[order - 1]
    back = np.argsort(transform, kind="stable").astype(np.int32)
    first = transform[back]
    parted = np.ones(len(text), bool)
    parted[1:] = first[1:] != first[:-1]
    left = np.flatnonzero(~parted)
    a, b = back[left], back[left - 1]
    for _ in range(1, length):
        interval = np.cumsum(parted, dtype=np.int32)
        new = interval[a] != interval[b]
        if not new.any():
            break
        parted[left[new]] = True
        left, a, b = left[~new], a[~new], b[~new]
    return np.cumsum(parted, dtype=np.int32)


def candidates(parts: list[bytes], n: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(index, bytes, first start, starts) of the contexts cut down to where a string's hash occurs again in the block.

    Equal strings have equal hashes, so nothing that repeats is lost; the transform decides on the rest.
    """
    size = np.array([len(p) for p in parts])
    sums = C.prefix_sums(np.frombuffer(b"".join(parts), np.uint8))
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(size) - size, n) + inner
    h = C.span_hash(sums, start, start + LENGTH)
    sorted_h = np.sort(h)
    again = sorted_h[1:][sorted_h[1:] == sorted_h[:-1]]
    at = np.minimum(np.searchsorted(again, h), max(len(again) - 1, 0))
    hit = np.flatnonzero(again[at] == h) if len(again) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(parts)), n)[hit]
    kept = np.unique(of)
    low, high = inner[hit[np.searchsorted(of, kept)]], inner[hit[np.searchsorted(of, kept, "right") - 1]]
    return kept, [parts[i][a : b + LENGTH] for i, a, b in zip(kept, low, high)], low, high - low + 1


def repeats(parts: list[bytes], n: np.ndarray) -> np.ndarray:
    """For contexts in order of their places: which of their starts (n per context, one after another) repeat an earlier one."""
    size = np.array([len(p) for p in parts])
    text = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(begin, n) + inner
    is_start = np.zeros(len(text), bool)
    is_start[start] = True
    order = suffix_order(text, LENGTH)
    interval = equal_prefixes(text, order, LENGTH)
    use = is_start[order]
    at, group = order[use], interval[use]
    cut = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    least = np.minimum.reduceat(at, cut)
    later = np.zeros(len(text), bool)
    later[at] = at != np.repeat(least, np.diff(np.append(cut, len(at))))
    return later[start]


def _spans(row, start, later) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, byte after the last) of runs of repeating starts that stand one after another."""
    row, start = row[later], start[later]
    if not len(start):
        return row, start, start
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (np.diff(start) != 1)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return row[new], start[new], start[last] + LENGTH


def repeated_spans(found: DataFrame) -> DataFrame:
    """(row, first, last): spans of bytes to remove; they may overlap."""
    spread = found.repartition(C.parts_of(found.sparkSession), "key")
    spread = spread.sortWithinPartitions("key", "doc_id", "row", "start")
    schema = "row bigint, first int, last int"

    def out(spans):
        row, first, last = _merged(*(np.concatenate(x) for x in zip(*spans)))
        columns = [pa.array(row, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["row", "first", "last"])

    def settled(t: pa.Table) -> pa.RecordBatch:
        """The spans of contexts of whole keys, in order of keys and places."""
        again = _again(t.column("bytes"))
        spans = [_ends(t.filter(pa.array(again)))]
        t = t.filter(pa.array(~again))
        kept, parts, first, n = candidates(t.column("bytes").to_pylist(), t.column("n").to_numpy().astype(np.int64))
        if not len(kept):
            return out(spans)
        t = t.select(["key", *(c for c, _ in PLACE)]).take(pa.array(kept))
        key, row = t.column("key").to_numpy(), t.column("row").to_numpy()
        begin = t.column("start").to_numpy().astype(np.int64) + first
        size = np.cumsum([len(p) for p in parts])
        # Blocks end between keys.
        whole = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        lo = 0
        while lo < len(key):
            full = np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK)
            hi = int(whole[min(np.searchsorted(whole, max(full, lo + 1)), len(whole) - 1)])
            place = lo + pc.sort_indices(t.slice(lo, hi - lo), sort_keys=PLACE, null_placement="at_start").to_numpy().astype(np.int64)
            m = n[place]
            later = repeats([parts[i] for i in place], m)
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            spans.append(_spans(np.repeat(row[place], m), np.repeat(begin[place], m) + inner, later))
            lo = hi
        return out(spans)

    def run(it):
        held, size, limit = [], 0, GATHER
        for b in it:
            settled_before = b.column(5).is_null()
            ready = pa.Table.from_batches([b.filter(settled_before)])
            if ready.num_rows:
                yield out([_ends(ready)])
            b = b.filter(pc.invert(settled_before))
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(5).nbytes
            if size >= limit:
                # The last key may go on.
                t = pa.Table.from_batches(held)
                at = int(np.searchsorted(t.column("key").to_numpy(), b.column(0)[-1].as_py()))
                if at:
                    yield settled(t.slice(0, at))
                held = t.slice(at).combine_chunks().to_batches()
                size = sum(x.column(5).nbytes for x in held)
                limit = max(GATHER, 2 * size)
        if held:
            yield settled(pa.Table.from_batches(held))

    return C.map_arrow(spread, run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what is left (bytes) of every row."""
    docs = docs.select("doc_id", "text")
    repeated = C.stage(repeated_keys(docs), "repeated-keys")
    spans = C.stage(repeated_spans(contexts(docs, repeated)), "repeated-spans")
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("_spans"))
    packed = C.packed_texts(docs, docs["doc_id"], F.xxhash64(docs["doc_id"], docs["text"]).alias("row"))
    both = packed.join(per_row, "row", "left").select("z", "doc_id", "_spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = C.fields(f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")

    def run(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                size, removed, count, left = [], [], [], []
                for text, spans in zip(C.unpacked(b.column(0)), b.column(2)):
                    kept, runs = text, 0
                    if spans.is_valid and len(spans):
                        values = spans.values
                        delta = np.zeros(len(text) + 1, np.int32)
                        np.add.at(delta, values.field("first").to_numpy(), 1)
                        np.add.at(delta, values.field("last").to_numpy(), -1)
                        gone = np.cumsum(delta[:-1]) > 0
                        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    size.append(len(text))
                    removed.append(len(text) - len(kept))
                    count.append(runs)
                    left.append(kept)
                yield C.batches(schema, b.column(1), size, removed, count, C.blobs(left))

    return C.map_arrow(both, run, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(C.table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
