"""Line deduplication: runs of two or more consecutive lines that stand elsewhere too.

Every two consecutive lines of a text (one of them with a word) are a piece, and so are two lines with words and the wordless
lines between them, or those before the first and after the last. Pieces overlap, so a run of any two or more lines is made of
pieces wherever it begins. A piece that stands anywhere else too is removed everywhere but at its first place (least
doc_id, then first in the text), once its bytes have been compared with those of the first place; overlapping pieces go
together. The first place of a line is never removed, as a piece that holds it can't stand before. A line that stands elsewhere
without either of its neighbours is no run and stays.

Hashes are counted with partial sums and joined back, so a piece that a third of all documents share is
no group of its own. Texts move twice, compressed: to cut out the bytes to compare, and to cut the pieces.

Null text gives null, empty text the empty text; both have nothing removed. Rows with equal id and text are treated alike:
all keep what one would keep. Rows without id keep everything. An empty table stays empty. Extra columns are
carried, and give way to outputs of their name.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulcomp.llm import common as C

CHUNK = "hash bigint, first int, last int"


def chunks(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The pieces in order: document, first byte, byte after the last, the same without a line end (in the document), hash."""
    cut = np.flatnonzero(buf == 10) + 1
    starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], cut]))
    starts = starts[starts < len(buf)] if len(buf) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    doc = np.searchsorted(off, starts, "right") - 1
    sums = C.prefix_sums(buf)
    # A last line without its newline hashes like one with it.
    bare = ends - (buf[ends - 1] == 10) if len(ends) else ends
    h = C.span_hash(sums, starts, bare)
    word_starts, _, _ = C.words(buf, off)
    some = np.searchsorted(word_starts, bare) > np.searchsorted(word_starts, starts)
    pair = np.flatnonzero((doc[1:] == doc[:-1]) & (some[1:] | some[:-1]))
    # Wordless lines that no pair holds: from one line with a word, or the document's first, to the next, or its last.
    edge = np.ones(len(doc), bool)
    edge[1:-1] = (doc[2:] != doc[1:-1]) | (doc[:-2] != doc[1:-1])
    stop = np.flatnonzero(some | edge)
    a, b = stop[:-1], stop[1:]
    far = (doc[a] == doc[b]) & (some[a] | some[b]) & ((b - a > 2) | ((b - a == 2) & ~(some[a] & some[b])))
    first, last = np.concatenate([pair, a[far]]), np.concatenate([pair + 1, b[far]])
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    of, lo, hi = doc[first], starts[first], bare[last]
    both = C.mix(C.span_hash(sums, lo, hi) + C.mix(h[first] * C.U(3) + h[last]))
    return {"doc": of, "first": lo - off[of], "last": ends[last] - off[of], "bare": hi - off[of], "hash": both}


def _tie():
    return F.xxhash64("text").alias("_tie")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, _tie, hash, d0, first, last): pieces whose hash occurs more than once; d0 is the least id that has it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = C.fields(f"doc_id {kind}, _tie bigint, {CHUNK}")

    def run(it):
        for batch in it:
            for lo, hi, buf, off in C.text_slices(batch.column(0)):
                c = chunks(buf, off)
                keys = [batch.column(i).slice(lo, hi - lo).take(pa.array(c["doc"])) for i in (1, 2)]
                yield C.batches(schema, *keys, c["hash"].view(np.int64), c["first"].astype(np.int32), c["last"].astype(np.int32))

    source = docs.filter("doc_id IS NOT NULL").select("text", "doc_id", _tie())
    rows = C.map_arrow(source, run, schema)
    places = rows.groupBy("hash").agg(F.min("doc_id").alias("d0"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows.join(places.drop("_n"), "hash")


def confirmed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, _tie, cuts): the pieces to remove from each document, equal in bytes to their first place."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    per_doc = found.groupBy("doc_id", "_tie").agg(
        F.sort_array(F.collect_set(F.struct("first", "last", "hash", "d0"))).alias("_chunks")
    )
    packed = C.packed_texts(docs, docs["doc_id"], F.xxhash64(docs["text"]).alias("_tie"))
    both = packed.join(per_doc, ["doc_id", "_tie"]).dropDuplicates(["doc_id", "_tie"])
    schema = C.fields(f"doc_id {kind}, _tie bigint, hash bigint, origin boolean, first int, last int, bytes binary")

    def run(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                out = []
                ids, ties, texts, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), C.unpacked(b.column(2)), b.column(3).to_pylist()
                for doc, tie, text, cuts in zip(ids, ties, texts, lists):
                    seen = set()
                    for c in cuts:
                        origin = doc == c["d0"] and c["hash"] not in seen
                        seen.add(c["hash"])
                        part = text[c["first"] : c["last"]]
                        out.append((doc, tie, c["hash"], origin, c["first"], c["last"], part.removesuffix(b"\n")))
                if out:
                    yield C.batches(schema, *[list(x) for x in zip(*out)])

    cut = C.stage(C.map_arrow(both.select("doc_id", "_tie", "z", "_chunks"), run, schema), "line-chunks")
    origin = cut.filter("origin").select("hash", F.col("bytes").alias("_bytes")).dropDuplicates(["hash"])
    same = cut.filter("NOT origin").join(origin, "hash").filter("bytes = _bytes")
    return same.groupBy("doc_id", "_tie").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("_cuts"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents' columns with the text cut, and n_lines, n_removed_lines, n_removed_bytes."""
    cuts = confirmed(docs, C.stage(repeated_chunks(docs), "line-repeats"))
    new = C.fields("n_lines bigint, n_removed_lines bigint, n_removed_bytes bigint").fields
    own = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]
    schema = T.StructType([*own, *new])
    names = [f.name for f in own]
    keys = [docs[c].alias(f"_c{i}") for i, c in enumerate(names) if c != "text"]
    packed = C.packed_texts(docs, *keys, docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_t"), docs["text"].isNull().alias("_null"))
    on = (packed["_id"] == cuts["doc_id"]) & (packed["_t"] == cuts["_tie"])
    both = packed.join(cuts, on, "left").drop("doc_id", "_tie", "_id", "_t")
    order = [f"_c{i}" for i, c in enumerate(names) if c != "text"]

    def run(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                texts, lines, gone, removed = [], [], [], []
                for text, cuts, null in zip(C.unpacked(col["z"]), col["_cuts"].to_pylist(), col["_null"].to_pylist()):
                    parts, at, cut_lines = [], 0, 0
                    for c in cuts or []:
                        if c["last"] <= at:
                            continue
                        begin, end = max(at, c["first"]), c["last"]
                        parts.append(text[at:begin])
                        cut_lines += text.count(b"\n", begin, end) + (end == len(text) and not text.endswith(b"\n"))
                        at = end
                    kept = b"".join([*parts, text[at:]])
                    texts.append(None if null else kept.decode())
                    lines.append(text.count(b"\n") + bool(text and not text.endswith(b"\n")))
                    gone.append(cut_lines)
                    removed.append(len(text) - len(kept))
                rest = iter([col[c] for c in order])
                yield C.batches(schema, *[pa.array(texts, pa.string()) if n == "text" else next(rest) for n in names], lines, gone, removed)

    return C.map_arrow(both, run, schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document, as digests."""
    left = without_repeats(C.table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256")
    return left.select("doc_id", "n_lines", "n_removed_lines", "n_removed_bytes", kept)


