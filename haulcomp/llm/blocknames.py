"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text is normalised (each run of white space to one space), cut into blocks of ``BLOCK`` bytes and spelled as a
sequence of integers, one name per block; equal blocks have equal names and different blocks different ones. Then
adjacent pairs of names are named, a last name without a partner pairing with none, until one name is left. Names of
one level are injective, so (level, last name) is the text's identity: two texts have it in common if and only if they
are equal. Nothing rests on a hash being free of collisions.

Names come from sorting. Blocks are dealt to 2 ** ``BUCKET_BITS`` buckets, each bucket's distinct blocks are sorted by
their bytes, and a name is (bucket, place). Pairs are named the same way, sorted by their two names. So names depend
on the set of blocks alone, not on partitions. The distinct blocks are the only texts that are moved, once, after
those of a task have been merged. Occurrences find their name by a 128-bit key instead of the bytes. Each bucket, where all its
blocks lie side by side, checks that the key tells them apart; if it doesn't anywhere, all is done again with another seed.

Hot names: a key that more than one in ``HOT_KEYS`` of all rows share is looked up in a table that goes to every task (at most
``HOT_KEYS`` rows); for all others a shuffle gives no task more than that share. Everything counted is a partial sum.

Null texts are empty texts, which equal each other and texts without any character (white space alone is one space).
Repeated rows are separate rows; of rows with one id either may stay. Null ids come after all others. A group in which all ids
are null keeps one of them, and its ``keep_id`` is null. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulcomp.llm import common as C

#: Bytes of a block.
BLOCK = 4096
#: Buckets among which distinct blocks and pairs are dealt before they are sorted.
BUCKET_BITS = 24
#: At most so many keys are sent to every task.
HOT_KEYS = 10_000
#: Tries at a key that tells all blocks apart.
SEEDS = 8
NONE = -1


def normalised(text: Column) -> Column:
    """The bytes that decide equality."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary")


def _cut(data: Column, block: int) -> Column:
    """The blocks of the bytes; the empty text has one empty block. The lambda holds the bytes, so cutting is linear."""
    n = F.greatest(F.ceil(F.length(data) / block).cast("int"), F.lit(1))
    cut = F.transform(F.array(data), lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(b, i * block + 1, block)))
    return cut[0]


def key_of(block: Column, seed: int) -> tuple[Column, Column]:
    """128 bits by which an occurrence finds the name of its block."""
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def _keyed(blocks: Column, seed: int, key) -> Column:
    def both(b: Column) -> Column:
        h, g = key(b, seed)
        return F.struct(h.alias("h"), g.alias("g"))

    return F.transform(blocks, both)


def _bucket(*cols: Column) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))


def _name(bucket: Column, place: Column) -> Column:
    return F.shiftleft(bucket, 32).bitwiseOR(place.cast("bigint"))


def _attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], cols: Sequence[str], total: int) -> DataFrame:
    """Rows with ``cols`` of the table, which has each of their keys once and in ``uses`` how many of the ``total`` rows have it."""
    share = total // HOT_KEYS
    narrow = table.select(*keys, "uses", *cols)
    # Fewer than HOT_KEYS keys can have more than total / HOT_KEYS rows each; of a smaller total no more than that exist.
    hot = narrow.filter(F.col("uses") > share).withColumn("_hot", F.lit(True)).drop("uses")
    seen = rows.join(F.broadcast(hot), list(keys), "left")
    rest = seen.filter(F.col("_hot").isNull()).drop("_hot", *cols)
    rest = rest.join(narrow.filter(F.col("uses") <= share).drop("uses"), list(keys))
    return seen.filter("_hot").drop("_hot").unionByName(rest)


def _named_blocks(docs: DataFrame, spelled: DataFrame, block: int, seed: int, key) -> DataFrame | None:
    """(h, g, name, uses) of every distinct block; None if two blocks share a key."""
    blocks = docs.select(normalised(docs["text"]).alias("_data")).select(F.explode(_cut(F.col("_data"), block)).alias("block"))
    sets = blocks.groupBy(_bucket(F.col("block")).alias("bucket")).agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    sets = sets.select("bucket", _keyed(F.col("blocks"), seed, key).alias("keys"))
    sets = sets.withColumn("clash", F.size(F.array_distinct("keys")) < F.size("keys"))
    named = sets.select("bucket", "clash", F.posexplode("keys").alias("place", "key"))
    named = C.stage(named.select("key.h", "key.g", "clash", _name(F.col("bucket"), F.col("place")).alias("name")), "block-names")
    # Keys of one bucket were compared above; a key in two buckets would be two rows here.
    twice = named.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.max("clash").alias("clash")).filter("n > 1 OR clash")
    if not twice.isEmpty():
        return None
    uses = spelled.select(F.explode("keys").alias("k")).groupBy("k.h", "k.g").agg(F.count(F.lit(1)).alias("uses"))
    return C.stage(named.drop("clash").join(uses, ["h", "g"]), "block-uses")


def _named_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, name, uses) of every distinct pair."""
    distinct = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses")).withColumn("bucket", _bucket(F.col("a"), F.col("b")))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("a", "b"))
    return C.stage(distinct.select("a", "b", "uses", _name(F.col("bucket"), place).alias("name")), "pair-names")


def identities(docs: DataFrame, block: int = BLOCK, key=key_of) -> DataFrame:
    """One row per document: ``row`` (a number of its own), doc_id, text_sha256, and its identity (level, name)."""
    for seed in range(SEEDS):
        data = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"], normalised(docs["text"]).alias("_data"))
        # Written once: the row numbers hold for all that follows.
        keys = _keyed(_cut(F.col("_data"), block), seed, key)
        spelled = data.select("row", "doc_id", F.sha2("_data", 256).alias("text_sha256"), keys.alias("keys"))
        spelled = C.stage(spelled, "spelled")
        names = _named_blocks(docs, spelled, block, seed, key)
        if names is not None:
            break
    else:
        raise RuntimeError(f"no key of {SEEDS} tells all blocks apart")

    total, most = spelled.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)), F.coalesce(F.max(F.size("keys")), F.lit(1))).first()
    places = spelled.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("i", "k"))
    sequence = _attach(places.select("row", "n", "i", "k.h", "k.g"), names, ["h", "g"], ["name"], total)
    sequence = C.stage(sequence.select("row", "n", "i", "name"), "names-0")
    if sequence.count() != total:
        raise RuntimeError("the documents changed between two readings")
    ends = []
    for level in range((most - 1).bit_length() + 1):
        if level:
            longer = sequence.filter("n > 1").groupBy("row", F.expr("i div 2").cast("int").alias("i"))
            odd = F.col("i") % 2 == 1
            pairs = longer.agg(
                F.ceil(F.max("n") / 2).cast("int").alias("n"),
                F.max(F.when(~odd, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(NONE).cast("bigint")).alias("b"),
            )
            pairs = C.stage(pairs, f"pairs-{level}")
            sequence = _attach(pairs, _named_pairs(pairs), ["a", "b"], ["name"], pairs.count())
            sequence = C.stage(sequence.select("row", "n", "i", "name"), f"names-{level}")
        ends.append(sequence.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
    ended = reduce(DataFrame.unionByName, ends)
    return C.stage(spelled.drop("keys").join(ended, "row"), "identities")


def exact_groups(docs: DataFrame, block: int = BLOCK, key=key_of) -> DataFrame:
    """``identities`` with keep_id, group_size and kept: the row with the smallest id of each group stays."""
    rows = identities(docs, block, key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    groups = C.stage(rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("uses"), first), "exact-groups")
    groups = groups.select("level", "name", "uses", F.col("uses").alias("group_size"), "first.*").drop("no_id")
    groups = groups.withColumnsRenamed({"doc_id": "keep_id", "row": "_keep"})
    out = _attach(rows, groups, ["level", "name"], ["group_size", "keep_id", "_keep"], rows.count())
    return out.withColumn("kept", F.col("row") == F.col("_keep")).drop("_keep")


def deduplicated(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One document of each group of equal texts, with its own columns."""
    numbered = C.stage(docs.withColumn("_number", F.monotonically_increasing_id()), "numbered-docs")
    bare = numbered.select(F.col("_number").alias("doc_id"), "text")
    ids = numbered.select(F.col("_number").alias("n_"), F.col("doc_id").alias("id_"))
    rows = identities(bare, block).withColumnRenamed("doc_id", "n_").join(ids, "n_")
    keep = rows.groupBy("level", "name").agg(F.min(F.struct(F.col("id_").isNull().alias("no_id"), "id_", "n_")).alias("first"))
    return numbered.join(keep.select(F.col("first.n_").alias("_number")), "_number", "left_semi").select(*docs.columns)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(C.table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def sql() -> str:
    """The query in DuckDB's SQL."""
    return r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d"""
