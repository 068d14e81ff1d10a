"""Exact duplicates against grouping by the normalised text itself."""

import hashlib
import re

import compare
import pytest
from conftest import SF
from pyspark.sql import functions as F

from haulcomp.llm import blocknames as B


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, order[0], len(ids), n == 0, sha) for n, i in enumerate(order)]
    return sorted(out, key=str)


def got(docs, **how):
    df = B.exact_groups(docs, **how)
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


TRICKY = [
    "abcdefgh" * 5, "abcdefgh" * 4, "abcdefgh" * 4 + "abcdefg", "abcdefgh" * 4 + "é", "a b", "a\t\n b", " a b", "a b ", "é" * 9, "ab" * 8, "ab" * 8 + "a",
    "x" * 16 + "y" * 16, "y" * 16 + "x" * 16, "x" * 16 + "y" * 16, "x" * 4097, "x" * 4096, "\x00", "", " ", None,
]


@pytest.mark.parametrize("block", [1, 8, 4096])
def test_groups(docs, odd, block):
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(TRICKY + TRICKY[:7])]
    if block == 1:
        rows = [(i, t) for i, t in rows if len(t or "") < 100]
    assert got(docs(rows), block=block) == plain(rows)
    if block > 1:
        assert got(odd, block=block) == plain(texts(odd))


@pytest.mark.parametrize("hot", [1, 3])
def test_names_used_often_and_seldom_take_either_road(docs, monkeypatch, hot):
    monkeypatch.setattr(B, "HOT_KEYS", hot)
    rows = [(i, "abcdefgh" * (i % 3 + 1) + str(i % 7)) for i in range(60)] + [(100 + i, "hot text of many rows") for i in range(40)]
    assert got(docs(rows), block=8) == plain(rows)


def test_a_key_that_confuses_blocks_is_replaced(docs):
    def weak(block, seed):
        return (F.length(block).cast("bigint"), F.lit(0).cast("bigint")) if seed == 0 else B.key_of(block, seed)

    rows = [(i, t) for i, t in enumerate(["abcd", "abce", "abcd", "abcdabce", "abceabcd"])]
    assert got(docs(rows), block=4, key=weak) == plain(rows)
    with pytest.raises(RuntimeError):
        B.identities(docs(rows), 4, lambda block, seed: weak(block, 0))


def test_names_do_not_depend_on_partitions(docs):
    df = docs([(i, f"text {i % 4} " * 9) for i in range(40)])
    one, many = [{r.doc_id: (r.level, r.name) for r in B.identities(x, 8).collect()} for x in (df.coalesce(1), df.repartition(7))]
    assert one == many


def test_kept_documents_have_their_columns(docs, odd):
    kept = B.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, norm(r.text)) for r in kept.collect()) == sorted(
        {t: (i is None, i or 0, t) for i, t in sorted(((i, norm(t)) for i, t in texts(odd)), key=lambda x: (x[0] is not None, -(x[0] or 0)))}.values()
    )
    assert B.exact_groups(odd.limit(0)).count() == 0
    assert B.deduplicated(odd.limit(0)).count() == 0


def test_a_very_long_text(docs):
    rows = [(1, "word " * 400_000), (2, "word  " * 400_000), (3, "word " * 400_000 + "x"), (4, " " * 2_000_000), (5, "\n" * 1_000_000)]
    assert got(docs(rows)) == plain(rows)


def test_equals_its_sql(spark):
    assert compare.check(spark, compare.connect(SF), "op11_exact_dedup", SF) is None
