"""Operators that look across documents against brute force, with nulls, repeats, hot groups and small limits."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from conftest import SF

from haulcomp.llm import binary, common, decontaminate, jaccard, lines, mixing, ngrams, substrings
from haulcomp.llm import vocabulary as V

from .conftest import words


@pytest.fixture(scope="module")
def documents(spark):
    return common.table(spark, SF, "documents")


# ---- exact substrings ----------------------------------------------------------------------


def plain_removed(rows):
    """[(n_removed, n_spans, sha256)] of rows in order of id."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        change = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - substrings.LENGTH + 1):
            part = raw[s : s + substrings.LENGTH]
            if part in seen:
                change[s] += 1
                change[s + substrings.LENGTH] -= 1
            seen.add(part)
        gone = np.cumsum(change[:-1]) > 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, rows = [text(40) for _ in range(3)], []
    for i in range(60):
        middle = rng.choice(shared)
        cut = rng.randint(0, 60)
        rows.append((i, text(rng.randint(0, 60)) + middle[cut:] + text(rng.randint(0, 20)) + rng.choice(["", middle])))
    rows += [(100, rows[3][1]), (101, "x" * 99), (102, "x" * 700), (103, "y" + "x" * 130), (104, "ab" * 300), (105, None), (106, "")]
    rows += [(107, ("abcdefghij" * 9 + "k\n") * 30), (108, "é" * 200), (109, rows[5][1][:150])]
    return rows


@pytest.mark.parametrize("hot, block, run, gather", [(40_000, 1 << 20, 1024, 4 << 20), (3, 2000, 7, 3000), (40_000, 500, 1024, 1)])
def test_substrings(docs, monkeypatch, hot, block, run, gather):
    for name, value in (("HOT", hot), ("BLOCK", block), ("RUN", run), ("GATHER", gather)):
        monkeypatch.setattr(substrings, name, value)
    rows = passages()
    rows = [(None, rows[7][1][:300] + "no id"), *rows]
    got = substrings.without_repeats(docs(rows, key="k", row="r")).toPandas().sort_values("doc_id", na_position="first")
    mine = [(r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.itertuples()]
    assert mine == plain_removed(rows)


@pytest.mark.parametrize("hot", [40_000, 10])
def test_a_hot_passage_gives_few_spans(docs, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    (passage, *texts), rng = [" ".join("".join(random.Random(f"{i} {j}").choices("abcdefgh", k=6)) for j in range(40)) for i in range(200)], random.Random(1)
    rows = [(i, t[: rng.randint(0, 200)] + passage + t[-rng.randint(1, 80) :]) for i, t in enumerate(texts)]
    table = docs(rows).repartition(4)
    spans = substrings.repeated_spans(substrings.contexts(table, substrings.repeated_keys(table))).toPandas()
    # Of 199 copies of 279 bytes, with some 180 strings each, nearly all are settled where they are read.
    assert spans.row.nunique() == len(rows) - 1
    assert len(spans) < 20 * len(rows)


def test_merged_spans():
    rng = np.random.default_rng(2)
    row, first = rng.integers(-3, 3, 300), rng.integers(0, 3000, 300)
    last = first + rng.integers(1, 20, 300)
    covered = {(r, i) for r, a, b in zip(row, first, last) for i in range(a, b)}
    got = list(zip(*substrings._merged(row, first, last)))
    assert {(r, i) for r, a, b in got for i in range(a, b)} == covered
    assert sum(b - a for _, a, b in got) == len(covered)
    assert all(p[0] != q[0] or p[2] < q[1] for p, q in zip(got, got[1:]))


def test_equal_prefixes_are_those_of_the_text():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    text[200:330] = text[20:150]
    order = substrings.suffix_order(text, 128)
    group = substrings.equal_prefixes(text, order, 100)
    wrapped = bytes(text) * 2
    for r in range(1, len(text)):
        same = wrapped[order[r] : order[r] + 100] == wrapped[order[r - 1] : order[r - 1] + 100]
        assert (group[r] == group[r - 1]) == same


def test_substrings_odd(odd):
    got = substrings.without_repeats(odd)
    assert got.count() == odd.count()
    assert substrings.without_repeats(odd.limit(0)).count() == 0


# ---- near duplicates -----------------------------------------------------------------------


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(25 if group == 0 else 6):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(30):
        rows.append((len(rows), " ".join(chain)))
        for _ in range(4):
            chain[rng.randrange(200)] = rng.choice(vocabulary)
    return rows + [(900, None), (901, ""), (902, "a b"), (903, "A\tb"), (904, " \n")]


@pytest.mark.parametrize("chunk", [2000, 4])
@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_components(docs, monkeypatch, chunk, n, percent):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = near_copies()
    got = jaccard.near_duplicates(docs(rows, node="x", block="y"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows, n, percent)


def test_bitmaps_never_exclude_a_link():
    rng = np.random.default_rng(2)
    parts = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64)
        parts += [np.unique(base), np.unique(np.concatenate([base, rng.integers(0, 1 << 62, 3).astype(np.uint64)]))]
    size = np.array([len(p) for p in parts])
    sets = jaccard.Sets(size, jaccard.bitmaps(np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])), parts)
    every = np.arange(len(parts))
    found = {frozenset(p) for p in jaccard.dual(jaccard.Tree(sets, every), jaccard.Tree(sets, every), 85) if p[0] != p[1]}
    linked = {frozenset((i, j)) for i, j in itertools.combinations(every.tolist(), 2) if sets.linked(i, sets, j, 85)}
    assert linked <= found and len(found) < len(parts) ** 2 / 4


def test_keep_one_of_each_component(odd, docs):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (2, "g h i j k l"), (4, None), (4, None)]
    kept = jaccard.keep_one(docs(rows, node="x"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4] and kept.columns == ["doc_id", "text", "node"]
    left = jaccard.keep_one(odd)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert jaccard.keep_one(odd.limit(0)).count() == 0


# ---- decontamination -----------------------------------------------------------------------


def plain_distance(window, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_within_the_edit_budget_and_no_others(spark, docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinsr") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 8, 40, 45)] + ["tiny", None]
    rows = []
    for i in range(60):
        item = rng.choice(items[:4])
        part = list(item[rng.randint(0, 60) :] if len(item) > 200 else item)
        for _ in range(rng.randint(0, 9)):
            part[rng.randrange(len(part))] = rng.choice("xyz")
        filler = lambda: " ".join(word() for _ in range(rng.randint(0, 12)))
        rows.append((i, f"{filler()} \n {''.join(part).upper()}  {filler()}"))
    rows += [(70, None), (71, ""), (72, items[2]), (72, items[2])]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    table = docs(rows, item_id="x")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_matches(table, benchmark).collect()}
    want = set()
    for d, text in rows:
        norm = " ".join((text or "").lower().split())
        for k, item in enumerate(items):
            item = " ".join((item or "").lower().split())
            size = min(len(item), decontaminate.WINDOW)
            if size < decontaminate.Q:
                continue
            starts = {*range(0, len(item) - size + 1, decontaminate.STRIDE), len(item) - size}
            if any(plain_distance(item[s : s + size], norm) <= decontaminate.budget(size) for s in starts):
                want.add((d, k))
    assert got == want and len(want) > 10
    clean = decontaminate.clean(table, benchmark)
    assert clean.columns == table.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.clean(table, benchmark.limit(0)).count() == len(rows)
    assert decontaminate.find_matches(table.limit(0), benchmark).count() == 0


def test_excerpts_of_100_to_123_bytes_at_every_offset(spark, docs):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    item = letters(300)
    parts = [(size, s) for size in range(100, 124) for s in range(300 - size + 1)]
    # A filler on both sides begins and ends with other letters than the item goes on with.
    rows = [(n, letters(20).upper() + "7" + item[s : s + size] + "7" + letters(20)) for n, (size, s) in enumerate(parts)]
    edited = [(10_000 + n, text[:40] + "7" + text[41:80] + text[81:]) for n, text in rows]
    short = [(20_000 + s, letters(30) + "7777777" + item[s : s + 93] + "7777777" + letters(30)) for s in range(0, 200, 7)]
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    table = docs([*rows, *edited, *short])
    got = {r.doc_id: r.edits for r in decontaminate.find_matches(table, benchmark).collect()}
    # All that hold a window are found, those edited twice too; 93 bytes are seven edits from any window.
    assert got.keys() == {i for i, _ in [*rows, *edited]}
    assert max(got.values()) <= decontaminate.budget(100)
    assert {r.doc_id for r in decontaminate.clean(table, benchmark).collect()} == {i for i, _ in short}


@pytest.mark.parametrize(("pairs", "piece"), [(50, 40), (500, 150)])
def test_pieces_of_periodic_texts_and_items_find_the_same(spark, docs, monkeypatch, pairs, piece):
    rng = random.Random(3)
    letters = lambda n, of="abc": "".join(rng.choice(of) for _ in range(n))
    units = [letters(rng.randint(1, 9)) for _ in range(6)]
    items = [(u * 200)[: rng.randint(20, 300)] for u in units] + [letters(300) for _ in range(3)]
    rows = [(n, letters(rng.randint(0, 200)) + rng.choice(items)[rng.randint(0, 9) :] + letters(20) + rng.choice(units) * 20) for n in range(25)]
    # Ids are text here, and one is missing.
    benchmark = spark.createDataFrame([(None if k == 1 else f"i{k}", x) for k, x in enumerate(items)], "item_id string, text string")
    table = docs(rows)
    whole = {(r.doc_id, r.item_id) for r in decontaminate.find_matches(table, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_matches(table, benchmark).collect()} == whole
    assert any(i is None for _, i in whole) and len(whole) > 25


def test_very_long_periodic_texts(spark, docs):
    benchmark = spark.createDataFrame([(1, "a" * 1000), (2, "ab" * 40 + "xyz" * 27)], "item_id bigint, text string")
    table = docs([(1, "a" * 300_000), (2, "ab" * 50_000), (3, " " * 2_000_000)])
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_matches(table, benchmark).collect()} == {(1, 1)}


def test_blocks_of_items_find_the_same(documents, spark, monkeypatch):
    benchmark = common.table(spark, SF, "benchmark")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.find_matches(documents, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 20_000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_matches(documents, benchmark).collect()} == whole


# ---- lines ---------------------------------------------------------------------------------


def test_repeated_chunks_go_but_for_the_first(docs, odd):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["red", "blue", "green", "tall", "small"]) + str(rng.randint(0, 99)) for _ in range(4))
    shared = [line() for _ in range(30)]
    rows = []
    for i in range(40):
        own = [line() for _ in range(rng.randint(0, 10))]
        rows.append((i, "\n".join([*own, *(shared if i % 3 == 0 else []), *[line() for _ in range(3)]])))
    rows += [(50, None), (51, ""), (52, "\n\n\n"), (53, "one line")]
    got = {r.doc_id: r.text for r in lines.without_repeats(docs(rows, n_lines="x", z="y")).collect()}
    seen, cut_some = {}, 0
    for i, text in rows:
        if text is None:
            assert got[i] is None
            continue
        raw, at, kept = text.encode(), 0, b""
        c = lines.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for first, last, bare in zip(c["first"], c["last"], c["bare"]):
            part = raw[first:bare]
            assert part.count(b"\n") >= 1
            if part in seen:
                kept += raw[at:first]
                at = last
                cut_some += 1
            seen[part] = i
        assert got[i].encode() == kept + raw[at:]
    assert cut_some > 10
    assert lines.without_repeats(odd).count() == odd.count()
    assert lines.without_repeats(odd.limit(0)).count() == 0


def test_short_passages_and_whole_copies_go(docs):
    rng = random.Random(11)
    count = itertools.count()
    line = lambda: f"line {next(count)} " + rng.choice("abc") * rng.randint(1, 60)
    passages = {n: [[line() for _ in range(n)] for _ in range(8)] for n in range(2, 7)}
    copied = [line(), "", "", " ", line(), line(), "", "", line()]
    rows = [(0, "\n".join(itertools.chain(*itertools.chain(*passages.values())))), (1, "\n".join(copied)), (2, "\n".join(["", "", *copied, "", ""]))]
    want = {0: rows[0][1], 1: rows[1][1]}
    for i, passage in enumerate(itertools.chain(*passages.values()), 10):
        head, tail = [line() for _ in range(rng.randint(0, 4))], [line() for _ in range(rng.randint(1, 4))]
        rows.append((i, "\n".join([*head, *passage, *tail])))
        want[i] = "\n".join([*head, *tail])
    rows += [(90, rows[0][1]), (91, rows[1][1]), (92, rows[2][1]), (93, rows[10][1] + "\n")]
    want |= {90: "", 91: "", 92: "", 93: ""}
    got = {r.doc_id: r for r in lines.without_repeats(docs(rows)).collect()}
    assert {i: got[i].text for i in want} == want
    for i, text in rows:
        assert got[i].n_removed_bytes == len(text) - len(got[i].text)
        assert got[i].n_removed_lines == got[i].n_lines - len(got[i].text.splitlines())


# ---- token ids -----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation(n):
    got = binary.permute(np.arange(n), n)
    assert sorted(got) == list(range(n))
    assert n < 100 or (got != np.arange(n)).mean() > 0.9


def test_shards_round_trip(spark, documents, odd, tmp_path):
    both = documents.limit(80).select("doc_id", "text").unionByName(odd.select("doc_id", "text").filter("doc_id <> 6 OR doc_id IS NULL"))
    both = both.filter("doc_id IS NULL OR doc_id > 9 OR text IS NOT NULL")
    folder = str(tmp_path / "shards")
    got = binary.write_shards(both, folder, length=64, rows=50)
    rows = sorted(got.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert {len(r.ids) for r in rows} == {128} and all(r.shard == r.slot // 50 for r in rows)
    bpe, found = V.byte_bpe(V.BYTE_BPE), collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.seq_no):
        if r.doc_id is not None and r.doc_id > 9:
            found[r.doc_id] += list(np.frombuffer(r.ids, bpe.dtype)[: r.n_tokens])
    texts = {r.doc_id: r.text for r in both.collect()}
    for doc, ids in found.items():
        assert ids[-1] == bpe.size and bpe.text(ids[:-1]) == texts[doc]
    part = binary.read_slots(spark, folder, 40, 30, rows=50)
    assert [r.slot for r in part.collect()] == list(range(40, 70))
    assert binary.write_shards(both.limit(0), str(tmp_path / "none")).count() == 0


# ---- mixing --------------------------------------------------------------------------------


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 50), (None, "en", None, 1000)],
        "domain string, lang string, source string, tokens bigint",
    )
    weights = {"domain": {"web": 2.0, "books": 1.0}, "lang": {}, "source": {"a": 3.0}}
    got = {r.source: r.budget for r in mixing.budgets(leaves, 0.4, 1, weights).collect()}
    # 1260 tokens by 2 : 1 : 1; books can give 50 of its 315, so web and the nameless share 1210 by 2 : 1.
    assert got["d"] == pytest.approx(50)
    assert got[None] == pytest.approx(1210 / 3)
    # In web both languages get half; a is short of its three quarters, b takes that over, c doesn't.
    assert got["c"] == pytest.approx(1210 / 3)
    assert got["a"] == pytest.approx(100) and got["b"] == pytest.approx(1210 / 3 - 100)


def test_prefix_meets_each_budget_by_less_than_a_document(docs, spark):
    rows = [(i, "w " * (1 + i % 17), "en", f"src{i % 5}") for i in range(600)] + [(700, None, "en", "src0"), (701, "x", None, None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, source string, copies string")
    measured = mixing.measured(table)
    chosen = mixing.choose(measured, 0.7, 3).toPandas()
    plan = mixing.budgets(measured.filter("n_tokens > 0").groupBy(*mixing.LEVELS).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens"), 0.7, 3, mixing.WEIGHTS).toPandas()
    taken = (chosen.n_tokens * chosen.copies).groupby(chosen.source.fillna("")).sum()
    for r in plan.itertuples():
        assert -1e-6 <= taken.get(r.source or "", 0) - r.budget < 17 + 1e-6
    assert 700 not in set(chosen.doc_id)
    out = mixing.mixed(table, 0.7, 3)
    assert out.columns == table.columns and out.count() == int(chosen.copies.sum())
    assert mixing.mixed(table.limit(0)).count() == 0


# ---- n-grams -------------------------------------------------------------------------------


def test_packed_numbers_and_pointers():
    rng = np.random.default_rng(0)
    for bits in (1, 7, 23, 40):
        x = rng.integers(0, 1 << bits, 300)
        assert (ngrams.unpack_at(ngrams.pack_ints(x, bits), np.arange(300), bits) == x).all()
    for top in (1, 50, 5000):
        pointers = np.sort(rng.integers(0, top, 700))
        assert (ngrams.ef_get(*ngrams.ef_build(pointers), np.arange(700)) == pointers).all()


def test_children_are_found_in_few_reads(monkeypatch, tmp_path):
    rng = np.random.default_rng(1)
    size = 1 << 20
    even = np.sort(rng.choice(size, 100_000, replace=False))
    # The last context's numbers lie as unevenly as can be.
    uneven = np.unique(np.concatenate([np.arange(3000), (1 << np.arange(20)) - 1, [size - 1]]))
    word, begin = np.concatenate([even, uneven]), np.array([0, 0, len(even), len(even), len(even) + len(uneven)])
    writer = ngrams.Writer(tmp_path.as_uri(), "level-0")
    for places in (np.array([0, 3, 3]), begin):
        ones, before = ngrams.ef_build(places)
        writer.add({"ones": ones, "before": before, "word": ngrams.pack_ints(word[: places[-1]], 21)})
    writer.close()
    file = ngrams.load(tmp_path.as_uri(), "level-0")
    reads, unpack = [], file.unpack
    monkeypatch.setattr(file, "unpack", lambda key, shard, at, bits: reads.append(len(at)) or unpack(key, shard, at, bits))

    def search(context, wanted):
        reads.clear()
        return ngrams.children(file, np.ones(len(wanted), int), np.full(len(wanted), context), wanted, 21, size)[0]

    assert (search(1, even) == np.arange(len(even))).all()
    assert sum(reads) < 6 * len(even)  # halving alone reads 17 times a word
    absent = np.setdiff1d(np.arange(size), even)[::7]
    assert (search(1, absent) == -1).all()
    assert (search(3, uneven) == len(even) + np.arange(len(uneven))).all() and len(reads) < 60
    assert (search(0, even[:9]) == -1).all() and (search(2, even[:9]) == -1).all()
    # Two shards of a file at once.
    got, first = ngrams.children(file, np.array([0, 0, 1, 1]), np.array([0, 1, 1, 3]), np.array([*even[:2], even[7], uneven[4]]), 21, size)
    assert got.tolist() == [0, -1, 7, len(even) + 4] and first.tolist() == [0, 3, 0, len(even)]


def test_codes_are_counted_and_placed():
    rng = np.random.default_rng(2)
    for top, bits in ((50, 6), (1 << 45, 45), (1 << 62, 62)):
        code = rng.integers(0, top, 3000)
        code[::3] = code[0]
        for got, want in zip(ngrams.distinct(code, bits), np.unique(code, return_inverse=True)):
            assert (got == want).all()
    runs = [np.unique(rng.integers(0, 900, n).astype(np.uint64), return_counts=True) for n in (0, 1, 500, 3000)]
    code, n = ngrams._summed(runs)
    want = collections.Counter()
    for c, m in runs:
        want.update(dict(zip(c.tolist(), m.tolist())))
    assert dict(zip(code.tolist(), n.tolist())) == want and (np.diff(code.astype(np.int64)) > 0).all()


def test_scores_do_not_depend_on_shards_and_files(documents, monkeypatch):
    few = documents.select("doc_id", "text").limit(60).localCheckpoint()
    model = ngrams.train_model(few, common.fresh_folder(few.sparkSession, "test-ngrams"), 1)
    want = {tuple(r) for r in ngrams.score(few, model).collect()}
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", model.tokens // 100)
    many = ngrams.train_model(few, common.fresh_folder(few.sparkSession, "test-ngrams"), 1)
    assert (model.shards, many.shards, many.per_file) == (8, 128, 2)
    assert {tuple(r) for r in ngrams.score(few, many).collect()} == want


def test_scores_against_a_plain_model(documents, odd):
    both = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).selectExpr("doc_id + 5000 as doc_id", "text"))
    train = both.filter(~ngrams.held_out(both["doc_id"]))
    model = ngrams.train_model(train, common.fresh_folder(documents.sparkSession, "test-ngrams"))
    got = {r.doc_id: r for r in ngrams.score(both, model).collect()}
    tokens = {r.doc_id: [*words(r.text), "\n"] for r in both.collect()}
    one, two, three, n_docs = collections.Counter(), collections.Counter(), collections.Counter(), 0
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            s = ["<s>", *w]
            one.update(w)
            two.update(zip(s, w))
            three.update(zip(s, w, w[1:]))
            n_docs += 1
    total, size = sum(one.values()), len(one)
    two, three = ({k: v for k, v in c.items() if v > 1} for c in (two, three))
    after, after2 = collections.defaultdict(list), collections.defaultdict(list)
    for u, v in two:
        after[u].append(v)
    for u, v, w in three:
        after2[u, v].append(w)
    seen = lambda u: n_docs if u == "<s>" else one[u]
    p1 = lambda w: (one[w] + 1) / (total + size + 1)
    back1 = {u: (1 - sum((two[u, v] - 0.75) / seen(u) for v in vs)) / (1 - sum(map(p1, vs))) for u, vs in after.items()}
    p2 = lambda v, w: (two[v, w] - 0.75) / seen(v) if (v, w) in two else back1.get(v, 1) * p1(w)
    back2 = {
        k: (1 - sum((three[(*k, w)] - 0.75) / two[k] for w in ws)) / (1 - sum(p2(k[1], w) for w in ws)) for k, ws in after2.items()
    }
    p3 = lambda u, v, w: (three[u, v, w] - 0.75) / two[u, v] if (u, v, w) in three else back2.get((u, v), 1) * p2(v, w)
    for i, w in tokens.items():
        s = [None, "<s>", *w]
        mine = sum(math.log10(p3(*s[k - 2 : k + 1])) for k in range(2, len(s)))
        r = got[i]
        assert abs(r.score - mine) < 2e-3 * len(w)
        assert r.base_score == pytest.approx(sum(math.log10(p1(x)) for x in w))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), total)
    # Probabilities after one history sum to one over the vocabulary and the unknown word.
    for v in list(after)[:5]:
        assert sum(p2(v, w) for w in one) + p2(v, "?") == pytest.approx(1)
    held = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_query_learns_from_ngrams_seen_once(spark, docs, tmp_path):
    rng = random.Random(3)
    docs([(i, " ".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(0, 9)))) for i in range(60)]).write.parquet(str(tmp_path / "documents.parquet"))
    tokens = {r.doc_id: [*words(r.text), "\n"] for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    held = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [["<s>", *w] for i, w in tokens.items() if i not in held]
    one, two, three = (collections.Counter(tuple(s[k : k + n]) for s in train for k in range(len(s) - n + 1)) for n in (1, 2, 3))
    n_docs = one.pop(("<s>",))
    total, size = sum(one.values()), len(one)
    p1 = lambda w: (one[w,] + 1) / (total + size + 1)

    def p(grams, n, history, w, lower):
        after = [g for g in grams if g[:-1] == history]
        if (*history, w) in grams:
            return (grams[*history, w] - 0.75) / n
        return (1 - sum((grams[g] - 0.75) / n for g in after)) / (1 - sum(lower(g[-1]) for g in after)) * lower(w) if after else lower(w)

    p2 = lambda v, w: p(two, n_docs if v == "<s>" else one[v,], (v,), w, p1)
    p3 = lambda u, v, w: p(three, two[u, v], (u, v), w, lambda x: p2(v, x))
    got = {r.doc_id: r for r in ngrams.op4_lm_scoring(spark, str(tmp_path)).collect()}
    assert 1 in two.values() and len(held) > 3
    for i, w in tokens.items():
        s = ["<s>", *w]
        mine = math.log10(p2(*s[:2])) + sum(math.log10(p3(*s[k - 2 : k + 1])) for k in range(2, len(s)))
        assert abs(got[i].score - mine) < 1e-3 * len(s)
        assert got[i].held_out == (i in held)


def test_no_training_documents(odd):
    model = ngrams.train_model(odd.limit(0), common.fresh_folder(odd.sparkSession, "test-ngrams"))
    got = ngrams.score(odd, model).collect()
    assert len(got) == odd.count() and all(r.n_known == 0 and r.score == r.base_score == 0 for r in got)
