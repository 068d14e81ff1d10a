"""Token-id output in training order: shards of fixed-stride records.

Every text becomes its token ids and one end id, cut into sequences of at most ``length`` ids. The
sequences are staged, numbered 0..n-1 (task by task), and a keyed Feistel permutation of the numbers, walked
along its cycle until it falls below n, gives each one its slot. Slots ``shard * rows`` and up make a shard:
one task sorts them and writes records of the same number of bytes (the last ids of a short
sequence are zero bytes; ``n_tokens`` tells how many count), so slot s stands at record s % rows of shard s // rows and
training resumes anywhere. A shard is written by one task as a whole or not at all.

Null and empty texts are one sequence with the end id only. Repeated rows are separate sequences. An
empty table gives no shards. Extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcomp.llm import common as C
from haulcomp.llm import vocabulary as V

LENGTH = 1024
#: Records in a shard: 8192 x 2 KB.
ROWS = 8192
SEED = 42
ROUNDS = 4


def permute(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """A keyed bijection of 0..n-1: balanced Feistel rounds on the least even number of bits, cycle-walked."""
    if n <= 1:
        return x.copy()
    half = (int(n - 1).bit_length() + 1) // 2
    mask = C.U((1 << half) - 1)
    keys = C.mix(np.arange(1, ROUNDS + 1).astype(C.U) * C.U(C.BASE) + C.U(seed))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> C.U(half), v & mask
        for k in keys:
            left, right = right, left ^ (C.mix(right + k) & mask)
        return (left << C.U(half)) | right

    out = once(x.astype(C.U))
    while True:
        beyond = out >= C.U(n)
        if not beyond.any():
            return out.astype(np.int64)
        out[beyond] = once(out[beyond])


def sequences(docs: DataFrame, vocabulary: str = V.BYTE_BPE, length: int = LENGTH) -> DataFrame:
    """One row per sequence: part and number within it, doc_id, seq_no, n_tokens, and the ids (compressed)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = C.fields(f"part int, number bigint, doc_id {kind}, seq_no int, n_tokens int, packed binary")

    def run(it):
        from pyspark import TaskContext

        bpe, part, number = V.byte_bpe(vocabulary), TaskContext.get().partitionId(), 0
        zip_ = zstandard.ZstdCompressor(level=3)
        end, step = np.array([bpe.size], bpe.dtype).tobytes(), length * bpe.dtype.itemsize
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                few = batch.slice(at, 500)
                row, seq, count, packed = [], [], [], []
                for i, text in enumerate(few.column(0).to_pylist()):
                    ids = bpe.pack(text or "") + end
                    for s, lo in enumerate(range(0, len(ids), step)):
                        one = ids[lo : lo + step]
                        row.append(i)
                        seq.append(s)
                        count.append(len(one) // bpe.dtype.itemsize)
                        packed.append(zip_.compress(one))
                numbers = np.arange(number, number + len(row))
                number += len(row)
                doc = few.column(1).take(pa.array(row, pa.int32()))
                yield C.batches(schema, np.full(len(row), part), numbers, doc, seq, count, C.blobs(packed))

    return C.map_arrow(docs.select(docs["text"], docs["doc_id"]), run, schema)


def with_slots(staged: DataFrame, seed: int = SEED, rows: int = ROWS) -> DataFrame:
    """Staged sequences with slot and shard. The numbers of rows per staged part are all that the driver sees."""
    counts = {r.part: r.n for r in staged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = np.zeros(max(counts, default=0) + 2, np.int64)
    for part, n in counts.items():
        first[part + 1] = n
    first = np.cumsum(first)
    total = int(first[-1])
    kind = staged.schema["doc_id"].dataType.simpleString()
    schema = C.fields(f"slot bigint, shard int, doc_id {kind}, seq_no int, n_tokens int, packed binary")

    def run(it):
        for b in it:
            index = first[b.column(0).to_numpy()] + b.column(1).to_numpy()
            slot = permute(index, total, seed)
            yield C.batches(schema, slot, slot // rows, *[b.column(i) for i in range(2, 6)])

    return C.map_arrow(staged, run, schema)


def write_shards(
    docs: DataFrame,
    folder: str,
    vocabulary: str = V.BYTE_BPE,
    length: int = LENGTH,
    rows: int = ROWS,
    seed: int = SEED,
) -> DataFrame:
    """Write the shards under ``folder`` and return them as a table: slot, doc_id, seq_no, n_tokens, ids, shard."""
    spark = docs.sparkSession
    width = length * V.byte_bpe(vocabulary).dtype.itemsize
    staged = sequences(docs, vocabulary, length)
    path = C.fresh_folder(spark, "sequences")
    # The ids are compressed already.
    staged.write.option("compression", "snappy").parquet(path)
    slots = with_slots(spark.read.schema(staged.schema).parquet(path), seed, rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = C.fields(f"slot bigint, doc_id {kind}, seq_no int, n_tokens int, ids binary, shard int")

    def unpack(it):
        unzip = zstandard.ZstdDecompressor()
        for b in it:
            for at in range(0, b.num_rows, 2000):
                few = b.slice(at, 2000)
                ids = [unzip.decompress(x).ljust(width, b"\0") for x in few.column(5).to_pylist()]
                yield C.batches(schema, few.column(0), *[few.column(i) for i in (2, 3, 4)], C.blobs(ids), few.column(1))

    ordered = slots.repartition(C.parts_of(spark), "shard").sortWithinPartitions("shard", "slot")
    C.map_arrow(ordered, unpack, schema).write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def read_slots(spark: SparkSession, folder: str, first: int, count: int, rows: int = ROWS) -> DataFrame:
    """Records first .. first + count - 1 in order; only their shards are opened."""
    shards = F.col("shard").between(first // rows, (first + count - 1) // rows)
    wanted = F.col("slot").between(first, first + count - 1)
    return spark.read.parquet(folder).filter(shards & wanted).orderBy("slot")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(C.table(spark, sf_dir, "documents"), C.fresh_folder(spark, "shards"))
