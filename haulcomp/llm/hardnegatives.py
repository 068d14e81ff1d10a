"""Hard negatives by windows of scores, over Hilbert-ordered blocks with zone maps.

Vectors are ordered along a Hilbert curve through all their dimensions, label by label, and written as a Parquet table with one row
per block of up to ``BLOCK`` neighbours of one label: smallest and largest entry of each dimension (the zone map), and the block's ids and
entries. Interval arithmetic on a zone map bounds every score that an anchor can have in the block:
the sum over dimensions of the smaller, or larger, of anchor * low and anchor * high. The bounds decide what is read.

* Positives: the anchor's own block gives a first five; another block of its label is read if its upper bound reaches the fifth score.
* Negatives: a block of another label is read if its bounds meet one of the anchor's windows, from 80 % of a positive's score up to that score.

Zone maps are read without the entries (they are columns of their own), in groups, by tasks that each hold a group of anchors.
That comparison deals anchors and zone maps over a grid, so no task gets all of either. What is read is one join on the block. Every block and
every anchor-block pair gives its best five at most; those are ranked per anchor and per window. No bound drops a row that could be among the first.

Rows without label, without vector, or with a null or non-finite entry take no part; an empty vector counts as null. Vectors of
several lengths, and entries beyond ``vectors.LARGEST`` after scaling, are errors. A null id is no anchor, comes after all other ids and keeps its label.
Repeated ids are separate rows, and separate anchors. Anchors without positives, and windows without negatives (all those of negative scores) give no row.
A window of one score (0) may hold rows. Empty tables give empty results. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulcomp.llm import common as C
from haulcomp.llm import vectors as V

#: Scale of entries, which rows are anchors, positives of an anchor and negatives of a window, the window in per cent.
SCALE, ANCHORS, TAKE, LEAST, MOST = 256, 100, 5, 80, 100
#: Vectors of a block, anchors of a group, zone maps of a group.
BLOCK, GROUP, ZONES = 1024, 256, 256
#: Bits per dimension of the curve.
BITS = 4
NEVER = -(1 << 62)

BLOCKS = "block bigint, label bigint, n int, low binary, high binary, ids array<bigint>, entries binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place on the Hilbert curve of each row of cells (d numbers of ``bits`` bits), as bytes in its order."""
    x = cells.astype(np.uint64)
    n, d = x.shape
    one = np.uint64(1)
    # Undo the rotations and reflections of the sub-cubes, from the largest cube down.
    for b in range(bits - 1, 0, -1):
        low = (one << np.uint64(b)) - one
        for i in range(d):
            flip = (x[:, i] >> np.uint64(b)) & one == one
            swap = np.where(flip, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap
    np.bitwise_xor.accumulate(x, axis=1, out=x)
    last = np.zeros(n, np.uint64)
    for b in range(bits - 1, 0, -1):
        last ^= np.where((x[:, d - 1] >> np.uint64(b)) & one == one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= last[:, None]
    planes = [((x >> np.uint64(b)) & one).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes, axis=1), axis=1)
    return [r.tobytes() for r in packed]


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor with any vector between ``low`` and ``high`` of each zone."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _dot(up, low) + _dot(down, high), _dot(up, high) + _dot(down, low)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: as doubles where those are exact, else in 64 bits."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _rows(data: bytes, d: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(-1, d)


def _ids(ids: list[int | None]) -> np.ndarray:
    """Ids to order ties by; a missing one comes last."""
    return np.array([(1 << 63) - 1 if i is None else i for i in ids], np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def candidates(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and ``q``, the scaled entries, of the rows that take part."""
    rows = embeddings.filter(embeddings["label"].isNotNull() & V.usable(embeddings["embedding"]))
    vec_id, label = rows["vec_id"].cast("bigint"), rows["label"].cast("bigint")
    moved = F.when(F.coalesce(vec_id % 7 == 0, F.lit(False)), F.pmod(label + 1, F.lit(10))).otherwise(label)
    return rows.select(vec_id.alias("vec_id"), moved.alias("label"), V.scaled(rows["embedding"], SCALE).alias("q"))


def write_blocks(rows: DataFrame, d: int, size: int = BLOCK, bits: int = BITS) -> DataFrame:
    """The blocks of a ``candidates`` table, as a Parquet table ordered by label and curve."""
    spark = rows.sparkSession
    by_entry = rows.select(F.posexplode("q").alias("at", "v")).groupBy("at").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    ends = sorted((r.at, r.low, r.high) for r in by_entry.collect())
    low, width = np.array([e[1] for e in ends]), np.array([e[2] - e[1] + 1 for e in ends])
    wide_first = np.argsort(-width, kind="stable")
    keyed_ddl = C.fields("vec_id bigint, label bigint, entries binary, place binary")

    def place(it):
        for b in it:
            q = V.matrix(b.column(2), d)
            cells = ((q - low) << bits) // width
            keys = hilbert_keys(cells[:, wide_first], bits) if len(q) else []
            yield C.batches(keyed_ddl, b.column(0), b.column(1), C.blobs([r.tobytes() for r in q.astype(np.int32)]), C.blobs(keys))

    order = ["label", "place", "vec_id"]
    keyed = C.map_arrow(rows, place, keyed_ddl)
    dealt = keyed.repartitionByRange(C.parts_of(spark), *order).sortWithinPartitions(*order)
    blocks_ddl = C.fields(BLOCKS)

    def pack(it):
        label, held, ids, part, count = None, [], [], 0, 0

        def block():
            q = _rows(b"".join(held), d)
            number = (part << 33) + count
            return C.batches(blocks_ddl, [number], [label], [len(q)], [q.min(axis=0).tobytes()], [q.max(axis=0).tobytes()], [ids], [q.tobytes()])

        for b in it:
            for vec_id, lab, entries, part_now in zip(*(c.to_pylist() for c in b.columns)):
                if held and (lab != label or len(held) == size):
                    yield block()
                    held, ids, count = [], [], count + 1
                label, part = lab, part_now
                held.append(entries)
                ids.append(vec_id)
        if held:
            yield block()

    numbered = dealt.select("vec_id", "label", "entries", F.spark_partition_id().cast("bigint").alias("part"))
    return C.stage(C.map_arrow(numbered, pack, blocks_ddl), "vector-blocks")


def anchor_groups(blocks: DataFrame, d: int, every: int, take: int, size: int = GROUP) -> DataFrame:
    """Groups of up to ``size`` anchors of one label in the blocks' order.

    ``home`` and ``spot`` say where an anchor stands, ``floor`` is the score its positives must reach: that of the
    last of the first ``take`` in its own block.
    """
    ddl = C.fields("label bigint, ids array<bigint>, home array<bigint>, spot array<int>, floor array<bigint>, entries binary")

    def run(it):
        label, held = None, []

        def group():
            ids, home, spot, floor, entries = zip(*held)
            return C.batches(ddl, [label], [ids], [home], [spot], [floor], [b"".join(entries)])

        for b in it:
            for block, lab, ids, entries in zip(*(c.to_pylist() for c in b.columns)):
                at = [i for i, v in enumerate(ids) if v is not None and v % every == 0]
                q = _rows(entries, d)
                scores = _dot(q[at], q)
                for s, i in zip(scores, at):
                    if held and (lab != label or len(held) == size):
                        yield group()
                        held = []
                    others = np.delete(s, i)
                    floor = int(np.partition(others, -take)[-take]) if len(others) >= take else NEVER
                    label = lab
                    held.append((ids[i], block, i, floor, q[i].tobytes()))
        if held:
            yield group()

    groups = C.map_arrow(blocks.select("block", "label", "ids", "entries"), run, ddl)
    return C.stage(groups.withColumn("grp", F.monotonically_increasing_id()), "anchor-groups")


def zone_groups(blocks: DataFrame, size: int = ZONES) -> DataFrame:
    """The zone maps alone, ``size`` to a row."""
    ddl = C.fields("blocks array<bigint>, labels array<bigint>, low binary, high binary")

    def run(it):
        for b in it:
            for lo in range(0, b.num_rows, size):
                block, label, low, high = (c.to_pylist() for c in b.slice(lo, size).columns)
                yield C.batches(ddl, [block], [label], [b"".join(low)], [b"".join(high)])

    return C.stage(C.map_arrow(blocks.select("block", "label", "low", "high"), run, ddl), "zone-maps")


def _grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of the left beside each of the right, dealt over about as many cells as there are partitions."""
    side = math.isqrt(C.parts_of(left.sparkSession) - 1) + 1
    deal = lambda df, own, other: df.withColumns(
        {own: F.pmod(F.xxhash64(*df.columns[:2]), F.lit(side)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(side - 1)))}
    )
    return deal(left, "_r", "_c").join(deal(right, "_c", "_r"), ["_r", "_c"]).drop("_r", "_c")


def choose_blocks(groups: DataFrame, zones: DataFrame, d: int) -> DataFrame:
    """(grp, block, who): the blocks that some anchors of a group must read, and the numbers of those anchors in the group.

    With ``windows`` (per anchor a list of least and largest score) blocks of other labels, else those of the group's own.
    """
    negative = "windows" in groups.columns
    ddl = C.fields("grp bigint, block bigint, who binary")
    asked = groups.select("grp", "entries", "label", "windows" if negative else "floor")
    pairs = _grid(asked, zones.withColumnsRenamed({"low": "z_low", "high": "z_high"}))

    def run(it):
        for b in it:
            for grp, entries, label, wanted, blocks, labels, low, high in zip(*(c.to_pylist() for c in b.columns)):
                other = (np.array(labels) != label) == negative
                if not other.any():
                    continue
                at = np.flatnonzero(other)
                least, most = bounds(_rows(entries, d), _rows(low, d)[at], _rows(high, d)[at])
                if negative:
                    hit = np.zeros(least.shape, bool)
                    for i, windows in enumerate(wanted):
                        for w in windows:
                            hit[i] |= (most[i] >= w["least"]) & (least[i] <= w["most"])
                else:
                    hit = most >= np.array(wanted)[:, None]
                read = np.flatnonzero(hit.any(axis=0))
                who = [np.flatnonzero(hit[:, j]).astype(np.int32).tobytes() for j in read]
                yield C.batches(ddl, pa.array(np.full(len(read), grp)), pa.array(np.array(blocks)[at[read]]), C.blobs(who))

    return C.stage(C.map_arrow(pairs, run, ddl), "chosen-blocks")


def _beside_blocks(chosen: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each chosen pair with the group's anchors and the block's vectors."""
    held = blocks.select("block", F.col("ids").alias("b_ids"), F.col("entries").alias("b_entries"))
    return chosen.join(groups.drop("label"), "grp").join(held, "block")


def positives(groups: DataFrame, blocks: DataFrame, zones: DataFrame, d: int, take: int) -> DataFrame:
    """(grp, anchor, p, positive_id, positive_score): the first ``take`` other rows of the anchor's label, p from 1."""
    ddl = C.fields("grp bigint, anchor int, positive_id bigint, positive_score bigint")
    pairs = _beside_blocks(choose_blocks(groups, zones, d), groups, blocks)
    pairs = pairs.select("grp", "block", "who", "home", "spot", "floor", "entries", "b_ids", "b_entries")

    def run(it):
        for b in it:
            for grp, block, who, home, spot, floor, entries, ids, held in zip(*(c.to_pylist() for c in b.columns)):
                who, order = np.frombuffer(who, np.int32), _ids(ids)
                anchors, found, values = [], [], []
                scores = _dot(_rows(entries, d)[who], _rows(held, d))
                for a, s in zip(who.tolist(), scores):
                    able = s >= floor[a]
                    if home[a] == block:
                        able[spot[a]] = False
                    at = np.flatnonzero(able)
                    at = at[_first(s[at], order[at], take)]
                    anchors += [a] * len(at)
                    found += [ids[i] for i in at]
                    values += s[at].tolist()
                yield C.batches(ddl, [grp] * len(anchors), anchors, found, values)

    best = Window.partitionBy("grp", "anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    ranked = C.map_arrow(pairs, run, ddl).withColumn("p", F.row_number().over(best)).filter(F.col("p") <= take)
    return C.stage(ranked, "positives")


def negatives(groups: DataFrame, blocks: DataFrame, zones: DataFrame, d: int, take: int) -> DataFrame:
    """(grp, anchor, p, rank, negative_id, negative_score) for groups with ``windows``, one per positive."""
    ddl = C.fields("grp bigint, anchor int, p int, negative_id bigint, negative_score bigint")
    pairs = _beside_blocks(choose_blocks(groups, zones, d), groups, blocks)
    pairs = pairs.select("grp", "who", "windows", "entries", "b_ids", "b_entries")

    def run(it):
        for b in it:
            for grp, who, windows, entries, ids, held in zip(*(c.to_pylist() for c in b.columns)):
                who, order = np.frombuffer(who, np.int32), _ids(ids)
                out = []
                scores = _dot(_rows(entries, d)[who], _rows(held, d))
                for a, s in zip(who.tolist(), scores):
                    least = min(w["least"] for w in windows[a])
                    near = np.flatnonzero(s >= least)
                    near = near[np.lexsort((order[near], -s[near]))]
                    falling = -s[near]
                    for w in windows[a]:
                        # The sorted scores of a window are one run; its first are the best.
                        start = int(np.searchsorted(falling, -w["most"], "left"))
                        end = min(int(np.searchsorted(falling, -w["least"], "right")), start + take)
                        out += [(a, w["p"], ids[i], int(s[i])) for i in near[start:end]]
                cols = list(zip(*out)) or [[]] * 4
                yield C.batches(ddl, [grp] * len(out), *cols)

    best = Window.partitionBy("grp", "anchor", "p").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return C.map_arrow(pairs, run, ddl).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= take)


def with_windows(groups: DataFrame, found: DataFrame, least: int, most: int) -> DataFrame:
    """The groups with each anchor's windows; a group has at most ``GROUP`` anchors and each a few windows."""
    # Whole-number division, as doubles round large products.
    low = F.expr(f"-(-positive_score * {least}L - pmod(-positive_score * {least}L, 100L)) div 100L")
    high = F.expr(f"(positive_score * {most}L - pmod(positive_score * {most}L, 100L)) div 100L")
    one = F.struct(F.col("p"), low.alias("least"), high.alias("most"))
    open_ = found.withColumn("w", one).filter(F.col("w.least") <= F.col("w.most"))
    by_anchor = open_.groupBy("grp", "anchor").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    by_group = by_anchor.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("anchor", "ws"))).alias("_of"))
    none = F.expr("cast(array() as array<struct<p:int,least:bigint,most:bigint>>)")
    each = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.coalesce(F.try_element_at(F.col("_of"), i), none))
    return groups.join(by_group, "grp").select("grp", "entries", "label", each.alias("windows"))


def mine(
    embeddings: DataFrame, every: int = ANCHORS, take: int = TAKE, least: int = LEAST, most: int = MOST, block: int = BLOCK, group: int = GROUP
) -> DataFrame:
    """Each anchor's positives, and for each of them the first negatives of its window."""
    rows = candidates(embeddings)
    d = V.dimension(rows, "q")
    if d is None:
        empty = "anchor_id bigint, positive_id bigint, p int, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return embeddings.sparkSession.createDataFrame([], empty)
    blocks = write_blocks(rows, d, block)
    groups, zones = anchor_groups(blocks, d, every, take, group), zone_groups(blocks)
    found = positives(groups, blocks, zones, d, take)
    asked = C.stage(with_windows(groups, found, least, most), "anchor-windows")
    got = negatives(asked, blocks, zones, d, take)
    names = groups.select("grp", F.posexplode("ids").alias("anchor", "anchor_id"))
    named = found.join(names, ["grp", "anchor"])
    out = got.join(named, ["grp", "anchor", "p"])
    return out.select("anchor_id", "positive_id", "p", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(C.table(spark, sf_dir, "embeddings")).drop("p")


def sql() -> str:
    """The query in DuckDB's SQL: every anchor against every row."""
    return f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
          WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        a AS (SELECT * FROM e WHERE vec_id % {ANCHORS} = 0),
        s AS (SELECT a.r AS a, a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same,
            CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * e.q[i])) AS BIGINT) AS score FROM a JOIN e ON a.r <> e.r),
        p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS p FROM s WHERE same),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.vec_id) AS INTEGER)
            AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON p.a = s.a AND NOT s.same
          WHERE p.p <= {TAKE} AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score)
        SELECT * FROM n WHERE rank <= {TAKE}"""
