"""Text columns as byte arrays inside tasks, span hashes, and small frame helpers.

A batch of texts is one array of UTF-8 bytes with document offsets; words, lines and windows are
spans in it, hashed all at once from one prefix sum. Everything here works on whole texts, in
slices of whole documents, so memory is bounded by ``SLICE`` bytes or one document, whichever is larger.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from haulcomp.session import shared_dir, stage  # noqa: F401  (stage is used by the operators)

SLICE = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

#: The white space of all word contracts.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n, modulo 2 ** 64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + 1)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            terms = np.full(size, base, U)
            terms[0] = 1
            _powers[name] = np.multiply.accumulate(terms)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes any span of the buffer."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * powers(len(buf))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes give equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def gram_hash(parts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive parts (document borders are the caller's business)."""
    m = len(parts) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for i in range(n):
        out = mix(out + parts[i : i + m] * U(2 * i + 0x9E3779B1))
    return out


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every document, and the index of each document's first word (plus the total)."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(off), np.int64)
    space = SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def text_slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def blobs(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


def batches(schema: T.StructType, *columns) -> pa.RecordBatch:
    """A record batch from columns in the schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)
    cols = [c.cast(f.type) if isinstance(c, pa.Array) and c.type != f.type else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, want)]
    return pa.RecordBatch.from_arrays(cols, names=want.names)


def fields(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; they may not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="haulcomp-py-"), "haulcomp-package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow with this package at hand in the tasks."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def with_text_columns(
    docs: DataFrame, keep: list[str], compute: Callable[[np.ndarray, np.ndarray], dict], ddl: str, text: str = "text"
) -> DataFrame:
    """The ``keep`` columns and computed ones; a kept column with the name of a computed one gives way to it."""
    new = fields(ddl)
    keep = [c for c in keep if c not in new.names]
    out = T.StructType([docs.schema[c] for c in keep] + new.fields)

    def run(it):
        for batch in it:
            for lo, hi, buf, off in text_slices(batch.column(0)):
                got = compute(buf, off)
                kept = [batch.column(i + 1).slice(lo, hi - lo) for i in range(len(keep))]
                yield batches(out, *kept, *[got[f.name] for f in new.fields])

    source = docs.select(docs[text].alias("_text"), *[docs[c] for c in keep])
    return map_arrow(source, run, out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def packed_texts(docs: DataFrame, *keys) -> DataFrame:
    """The key columns (columns of ``docs``, aliased) and ``z``, the compressed text, for a shuffle of whole texts."""
    source = docs.select(docs["text"].alias("_text"), *keys)
    schema = T.StructType([*source.schema.fields[1:], T.StructField("z", T.BinaryType())])

    def run(it):
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3)
        for b in it:
            for lo in range(0, b.num_rows, 1000):
                few = b.slice(lo, 1000)
                z = blobs([zip_.compress((t or "").encode()) for t in few.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*few.columns[1:], z], names=schema.names)

    return map_arrow(source, run, schema)


def unpacked(column: pa.Array) -> list[bytes]:
    """The texts of a slice of ``z``."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    return [unzip.decompress(z) for z in column.to_pylist()]
