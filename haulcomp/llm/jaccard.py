"""Exact word-shingle Jaccard join with signature trees, as components of linked documents.

1. A text becomes the set of hashes of its distinct n-word shingles (A-Z lower-cased; fewer words: the whole
   sequence as one). Documents with one set share a node, named by a 64-bit hash of the set.
2. Two sets that reach the threshold share a shingle among the first size - ceil(t * size) + 1 of each, in any common
   order of all shingles. The order is rare first: shingle counts over all documents are summed in a sketch
   of 2 ** SLOT_BITS slots (a fixed size), ties by hash. So passages that many documents share
   stand last and hardly ever bring documents together.
3. A key (shingle of a prefix) that several nodes of compatible sizes share has a pivot. Sizes are cut into classes a
   factor t apart; a node shows up in its class and the next, so compatible sizes meet. Nodes of the keys of one
   pivot and class are a block; any linked pair shares a key, so it meets in a block. Blocks are cut into chunks
   of at most CHUNK nodes, each with the pivot.
   a. Bitmaps alone (a 16th of a set or less): a node that can't overlap enough with any other node of its block leaves.
   b. With the sets: all nodes are tried against the pivot; those that link are settled with respect to each
      other. The rest is joined with the whole chunk, as long as a pair can join two components; what doesn't reach the
      pivot then meets the other chunks of its block too.
   Both go by dual traversal of two signature trees: a tree's nodes hold the OR of their sets' bitmaps, the range of
   sizes and the most collisions, from which the largest possible overlap follows.
4. Verified links between nodes are joined to components by label propagation with pointer jumping.

Every pair of a block is tried, excluded by a bound, or known to be connected already, so components are exact, whatever the size of a group of copies; no group of pairs is written out.

Null and empty texts have no shingles and are alone. Equal rows share a set, so they share a component. A document
id that occurs twice is treated as two texts and its rows' components are reported row by row. A text without id links
like any other and takes the least id of its component, which is null only if no text of it has an id. An empty table gives an
empty result; extra columns are not looked at. Hashes have 64 bits: among d different sets d * d / 2 ** 65 false matches are
to be expected (1e-9 for a million documents).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcomp.llm import common as C

#: Near duplicates unless a contract says otherwise.
WORDS, PERCENT = 5, 80
SLOT_BITS = 18
#: Nodes of a block that one task takes at once.
CHUNK = 2000
LEAF, FAN = 16, 8


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first index per document and the end): the sorted distinct shingles of every document."""
    buf = C.LOWER[buf]
    docs = len(off) - 1
    starts, ends, first = C.words(buf, off)
    count = np.diff(first)
    doc = np.repeat(np.arange(docs), count)
    h = C.span_hash(C.prefix_sums(buf), starts, ends)
    grams = C.gram_hash(h, n)
    inside = doc[n - 1 :] == doc[: len(grams)] if len(grams) else np.zeros(0, bool)
    found, of = [grams[inside]], [doc[: len(grams)][inside]]
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            whole = C.gram_hash(h, m)[first[short]]
            found.append(C.mix(whole + C.U(m)))
            of.append(short)
    h, doc = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(docs + 1))


def set_hash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash per set (0 for an empty one): the sum of its mixed members, mixed."""
    sums = np.concatenate([np.zeros(1, C.U), np.cumsum(C.mix(h ^ C.U(0xA5A5A5A5A5A5A5A5)), dtype=C.U)])
    total = sums[first[1:]] - sums[first[:-1]]
    return np.where(np.diff(first) > 0, C.mix(total), C.U(0)).view(np.int64)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> C.U(64 - SLOT_BITS)).astype(np.int64)


def bitmap_bits(size: np.ndarray) -> np.ndarray:
    """Length of the bitmap of a set: the power of two from twice its size up, 64 at least."""
    return 1 << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64)


def bitmaps(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The bitmap of each set, by the low bits of its members."""
    size = np.diff(first)
    length = bitmap_bits(size)
    start = np.concatenate([[0], np.cumsum(length)])
    flags = np.zeros(int(start[-1]), bool)
    doc = np.repeat(np.arange(len(size)), size)
    flags[start[doc] + (h & (length[doc] - 1).astype(C.U)).astype(np.int64)] = True
    packed = np.packbits(flags, bitorder="little")
    return [packed[start[i] // 8 : start[i + 1] // 8].tobytes() for i in range(len(size))]


def _row_id(docs: DataFrame):
    """A hash of id and text: rows of one id and different texts are different rows."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def document_nodes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row, n_shingles, node and bits (null without shingles) of every row."""

    def compute(buf, off):
        h, first = shingle_sets(buf, off, n)
        size = np.diff(first)
        none = size == 0
        return {"n_shingles": size, "node": pa.array(set_hash(h, first), mask=none), "bits": C.blobs([None if e else b for e, b in zip(none, bitmaps(h, first))])}

    rows = docs.select("doc_id", "text", _row_id(docs).alias("row"))
    return C.with_text_columns(rows, ["doc_id", "row"], compute, "n_shingles bigint, node bigint, bits binary")


def slot_counts(docs: DataFrame, n: int) -> np.ndarray:
    """In how many documents the shingles of each slot occur: a fixed number of sums over all documents."""

    def run(it):
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in it:
            for _, _, buf, off in C.text_slices(batch.column(0)):
                total += np.bincount(_slot(shingle_sets(buf, off, n)[0]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "n"])

    rows = C.map_arrow(docs.select("text"), run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[rows["slot"].to_numpy(int)] = rows["n"].to_numpy()
    return counts


def prefix_keys(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(key, node): the shingles of every set's prefix."""

    def run(it):
        for batch in it:
            for _, _, buf, off in C.text_slices(batch.column(0)):
                h, first = shingle_sets(buf, off, n)
                size = np.diff(first)
                doc = np.repeat(np.arange(len(size)), size)
                node = set_hash(h, first)
                order = np.lexsort((h, counts[_slot(h)], doc))
                take = size - (-(-percent * size // 100)) + 1
                at = np.arange(len(h)) - first[:-1][doc]
                keep = at < take[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[order][keep].view(np.int64)), pa.array(node[doc][keep])], names=["key", "node"]
                )

    return C.map_arrow(docs.select("text"), run, "key bigint, node bigint")


def memberships(keys: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(block, tag, chunks, chunk, node): the nodes of every shared key under its pivot, in chunks that all have the pivot.

    A tag holds the sizes of its class and of the class below; its pivots are of its class.
    """
    shared = keys.groupBy("key").agg(F.min("node").alias("_least"), F.max("node").alias("_most"))
    shared = shared.filter("_least < _most").select("key")
    size_class = F.floor(F.log("n_shingles") / F.lit(float(np.log(100 / percent)))).cast("int")
    rows = keys.join(shared, "key").join(sizes.select("node", size_class.alias("_class")), "node")
    rows = rows.select("key", "node", "_class", F.explode(F.array(F.col("_class"), F.col("_class") + 1)).alias("tag"))
    pivot = F.min(F.when(F.col("_class") == F.col("tag"), F.col("node"))).alias("block")
    groups = rows.groupBy("key", "tag").agg(pivot, F.min("node").alias("_least"), F.max("node").alias("_most"))
    groups = groups.filter("block IS NOT NULL AND _least < _most").select("key", "tag", "block")
    members = C.stage(rows.join(groups, ["key", "tag"]).select("block", "tag", "node").distinct(), "memberships")
    counts = members.groupBy("block", "tag").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))
    members = members.join(counts, ["block", "tag"])
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("chunks") - 1)
    chunk = F.explode(F.when(F.col("node") == F.col("block"), everywhere).otherwise(F.array(own)))
    return members.select("block", "tag", "chunks", chunk.alias("chunk"), "node")


def _in_chunks(rows: DataFrame) -> DataFrame:
    spread = rows.repartition(C.parts_of(rows.sparkSession), "block", "tag", "chunk")
    return spread.sortWithinPartitions("block", "tag", "chunk")


def possible_members(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Members whose bitmap leaves room for a link inside their chunk; those of cut blocks all stay."""
    rows = _in_chunks(members.join(nodes, "node").select("block", "tag", "chunk", "chunks", "node", "n_shingles", "bits"))
    schema = members.schema

    def run(it):
        for t in sorted_groups(it, 3):
            stay = np.ones(t.num_rows, bool)
            if t.column("chunks")[0].as_py() == 1:
                sets = Sets(t.column("n_shingles").to_numpy(), t.column("bits").to_pylist())
                pivot = int(np.flatnonzero(t.column("node").to_numpy() == t.column("block")[0].as_py())[0])
                stay = sets.may_link(pivot, percent)
                stay[pivot] = False
                rest = np.flatnonzero(~stay)
                near = stay.copy()
                near[pivot] = stay.any()
                if len(rest) > 1:
                    for i, j in dual(Tree(sets, rest), Tree(sets, np.arange(len(stay))), percent):
                        if i != j:
                            near[i] = near[j] = True
                stay = near
            if stay.any():
                kept = t.filter(pa.array(stay)).select(schema.names)
                yield from kept.combine_chunks().to_batches()

    return C.map_arrow(rows, run, schema)


def node_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles): the set of each wanted node, from one row that has it."""
    one = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))

    def sets(it):
        for b in it:
            for lo in range(0, b.num_rows, 500):
                few = b.slice(lo, 500)
                texts = C.blobs(C.unpacked(few.column(0)))
                for at, to, buf, off in C.text_slices(texts):
                    h, first = shingle_sets(buf, off, n)
                    node = set_hash(h, first)
                    parts = [h[first[i] : first[i + 1]].tobytes() for i in range(to - at)]
                    yield pa.RecordBatch.from_arrays([pa.array(node), few.column(1).slice(at, to - at), C.blobs(parts)], names=["node", "want", "shingles"])

    packed = C.packed_texts(docs, _row_id(docs).alias("row"))
    found = C.map_arrow(packed.join(one, "row").select("z", "node"), sets, "node bigint, want bigint, shingles binary")
    # Rows whose hashes are equal by chance may bring another text than the wanted one.
    return found.filter("node = want").drop("want").dropDuplicates(["node"])


class Sets:
    """Sizes and bitmaps of sets, the bitmaps folded to the shortest length among them, and the sets if at hand."""

    def __init__(self, size: np.ndarray, bits: list[bytes], parts: list[np.ndarray] | None = None):
        shortest = min(map(len, bits))
        self.size, self.parts = size.astype(np.int64), parts
        self.bits = np.stack([np.bitwise_or.reduce(np.frombuffer(b, C.U).reshape(-1, shortest // 8), 0) for b in bits])
        self.clash = self.size - np.bitwise_count(self.bits).sum(1).astype(np.int64)

    def may_link(self, one: int, percent: int) -> np.ndarray:
        """Which sets could reach the threshold with one of them, by size and bitmap."""
        shared = np.bitwise_count(self.bits & self.bits[one]).sum(1).astype(np.int64)
        most = np.minimum(np.minimum(self.size, self.size[one]), shared + np.minimum(self.clash, self.clash[one]))
        return (100 + percent) * most >= percent * (self.size + self.size[one])

    def linked(self, a: int, other: "Sets", b: int, percent: int) -> bool:
        x, y = self.parts[a], other.parts[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        shared = int((y[at] == x).sum()) if len(y) else 0
        return 100 * shared >= percent * (len(x) + len(y) - shared)


class Joined:
    """Components of a task's own sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(j)] = self.find(i)


def new_links(tried: Iterator[tuple[int, int]], a: Sets, percent: int, known: Joined) -> Iterator[tuple[int, int]]:
    """The verified pairs that join two components: no more of them than sets."""
    for i, j in tried:
        if known.find(i) != known.find(j) and a.linked(i, a, j, percent):
            known.join(i, j)
            yield i, j


class Tree:
    """Levels of nodes over sets in order of size; level 0 are leaves of up to LEAF sets."""

    def __init__(self, sets: Sets, which: np.ndarray):
        self.sets, self.order = sets, which[np.argsort(sets.size[which], kind="stable")]
        cut = np.arange(0, len(self.order), LEAF)
        size, bits, clash = sets.size[self.order], sets.bits[self.order], sets.clash[self.order]
        level = (np.bitwise_or.reduceat(bits, cut, 0), np.minimum.reduceat(size, cut), np.maximum.reduceat(size, cut), np.maximum.reduceat(clash, cut))
        self.levels = [level]
        while len(level[1]) > 1:
            cut = np.arange(0, len(level[1]), FAN)
            level = (np.bitwise_or.reduceat(level[0], cut, 0), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut))
            self.levels.append(level)

    def children(self, depth: int, i: int) -> range:
        return range(i * FAN, min((i + 1) * FAN, len(self.levels[depth - 1][1])))


def possible(x, i, y, j, percent: int) -> bool:
    """Can sets under node i of level x and node j of level y reach the threshold?"""
    if 100 * x[2][i] < percent * y[1][j] or 100 * y[2][j] < percent * x[1][i]:
        return False
    most = min(x[2][i], y[2][j], int(np.bitwise_count(x[0][i] & y[0][j]).sum()) + min(x[3][i], y[3][j]))
    return (100 + percent) * most >= percent * (x[1][i] + y[1][j])


def dual(a: Tree, b: Tree, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of sets (of a, of b) that no bound excludes."""
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        da, i, db, j = stack.pop()
        if not possible(a.levels[da], i, b.levels[db], j, percent):
            continue
        if da == 0 and db == 0:
            p, q = a.order[i * LEAF : (i + 1) * LEAF], b.order[j * LEAF : (j + 1) * LEAF]
            sa, sb = a.sets.size[p][:, None], b.sets.size[q][None, :]
            shared = np.bitwise_count(a.sets.bits[p][:, None, :] & b.sets.bits[q][None, :, :]).sum(2).astype(np.int64)
            clash = np.minimum(a.sets.clash[p][:, None], b.sets.clash[q][None, :])
            most = np.minimum(np.minimum(sa, sb), shared + clash)
            for u, v in zip(*np.nonzero((100 + percent) * most >= percent * (sa + sb))):
                yield int(p[u]), int(q[v])
        elif da >= db:
            stack += [(da - 1, c, db, j) for c in a.children(da, i)]
        else:
            stack += [(da, i, db - 1, c) for c in b.children(db, j)]


def sorted_groups(it, width: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``width`` columns, from batches in their order."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in it:
        if not b.num_rows:
            continue
        keys = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        lo = 0
        for hi in [*cuts, b.num_rows]:
            if held and tuple(keys[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[lo])
            held.append(b.slice(lo, hi - lo))
            lo = hi
    if held:
        yield pa.Table.from_batches(held)


def _sets_of(table: pa.Table) -> Sets:
    parts = [np.frombuffer(x, C.U) for x in table.column("shingles").to_pylist()]
    size = np.array([len(p) for p in parts])
    return Sets(size, bitmaps(np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])), parts)


def _pairs(block, a: list, b: list) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) for x in (a, b)]
    where = [pa.array([v] * len(a), t) for v, t in zip(block, (pa.int64(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*where, *columns], names=["block", "tag", "chunk", "a", "b"])


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(links inside chunks, links between chunks of cut blocks) as pairs a, b of nodes."""

    def chunks(it):
        for t in sorted_groups(it, 3):
            if t.num_rows < 2:
                continue
            node, own = t.column("node").to_numpy(), _sets_of(t)
            pivots = np.flatnonzero(node == t.column("block")[0].as_py())
            hit = np.zeros(len(node), bool)
            pairs, known = [], Joined(len(node))
            if len(pivots):
                pivot = int(pivots[0])
                may = own.may_link(pivot, percent)
                hit = np.array([i == pivot or bool(may[i]) and own.linked(pivot, own, i, percent) for i in range(len(node))])
                pairs = [(pivot, int(i)) for i in np.flatnonzero(hit) if i != pivot]
                for _, i in pairs:
                    known.join(pivot, i)
            rest = np.flatnonzero(~hit)
            if len(rest) and len(node) > 1 + len(pivots):
                pairs += new_links(dual(Tree(own, rest), Tree(own, np.arange(len(node))), percent), own, percent, known)
                if len(pivots):
                    # What reaches the pivot by way of others is settled as well.
                    rest = np.array([i for i in rest if known.find(int(i)) != known.find(pivot)], np.int64)
            a, b = [node[i] for i, _ in pairs], [node[j] for _, j in pairs]
            if t.column("chunks")[0].as_py() > 1:
                # A missing partner marks a node that the other chunks still have to see.
                a, b = a + list(node[rest]), b + [None] * len(rest)
            if a:
                yield _pairs([t.column(c)[0].as_py() for c in ("block", "tag", "chunk")], a, b)

    with_sets = members.join(sets, "node").select("block", "tag", "chunk", "chunks", "node", "shingles")
    found = C.stage(C.map_arrow(_in_chunks(with_sets), chunks, "block bigint, tag int, chunk int, a bigint, b bigint"), "block-links")
    links = found.filter("b IS NOT NULL").select("a", "b")
    rest = found.filter("b IS NULL").select("block", "tag", "chunk", F.col("a").alias("node"))
    if rest.isEmpty():
        return links, None
    # Cut blocks only: chunks that have something left against all other chunks.
    cut = members.filter("chunks > 1 AND node <> block")
    left = cut.join(rest, ["block", "tag", "chunk", "node"], "left_semi")
    cu, cm = F.col("chunk").alias("cu"), F.col("chunk").alias("cm")
    others = left.select("block", "tag", cu).distinct()
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("cm")
    left = left.select("block", "tag", cu, every, F.lit(True).alias("rest"), "node")
    whole = cut.select("block", "tag", cm, "node").join(others, ["block", "tag"])
    both = left.unionByName(whole.select("block", "tag", "cu", "cm", F.lit(False).alias("rest"), "node")).filter("cu <> cm")
    both = both.join(sets, "node").select("block", "tag", "cu", "cm", "rest", "node", "shingles")
    spread = both.repartition(C.parts_of(members.sparkSession), "block", "tag", "cu", "cm").sortWithinPartitions("block", "tag", "cu", "cm")

    def across(it):
        for t in sorted_groups(it, 4):
            is_rest, node, own = t.column("rest").to_numpy(), t.column("node").to_numpy(), _sets_of(t)
            u, m = np.flatnonzero(is_rest), np.flatnonzero(~is_rest)
            if len(u) and len(m):
                found = new_links(dual(Tree(own, u), Tree(own, m), percent), own, percent, Joined(len(node)))
                pairs = [(node[i], node[j]) for i, j in found]
                if pairs:
                    a, b = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links, C.stage(C.map_arrow(spread, across, "a bigint, b bigint"), "cross-links")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each linked node's component."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = C.stage(both, "edges")
    labels = C.stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("_at"), F.col("label").alias("_up"))
        step = step.join(up, step["label"] == up["_at"]).select("node", "old", F.least("label", "_up").alias("label"))
        step = C.stage(step, "labels")
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels


def grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, row, n_shingles and group of every row; the group names a component, null without shingles."""
    docs = docs.select("doc_id", "text")
    nodes = C.stage(document_nodes(docs, n), "nodes")
    keys = prefix_keys(docs, n, percent, slot_counts(docs, n))
    one = nodes.filter("node IS NOT NULL").select("node", "n_shingles", "bits").dropDuplicates(["node"])
    members = C.stage(possible_members(memberships(keys, one.select("node", "n_shingles"), percent), one, percent), "members")
    sets = C.stage(node_sets(docs, nodes.drop("bits"), members.select("node").distinct(), n), "sets")
    links, more = block_links(members, sets, percent)
    labels = components(links if more is None else links.unionByName(more))
    # A node without a link is a component of its own; documents without shingles stay alone.
    named = nodes.drop("bits").join(labels, "node", "left")
    return named.select("doc_id", "row", "n_shingles", F.coalesce("label", "node").alias("group"))


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (columns doc_id, text)."""
    named = grouped(docs, n, percent)
    least = named.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "group", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the least id, rows without id last, ties by a hash of the text.

    Ids may repeat: of near copies under one id one stays. Texts without shingles all stay, rows with equal id and
    text once (without an id: all).
    """
    named = C.stage(grouped(docs, n, percent), "groups")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    first = named.filter("group IS NOT NULL").groupBy("group").agg(order).select("first.row")
    keep = first.union(named.filter("group IS NULL").select("row")).distinct().withColumnRenamed("row", "_keep")
    wordless = docs["text"].isNull() | ~docs["text"].rlike(r"[^\x20\x09-\x0D]")
    loose = docs["doc_id"].isNull() & wordless
    kept = docs.filter(~loose).join(keep, _row_id(docs) == keep["_keep"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter(loose))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), 4, 85)
