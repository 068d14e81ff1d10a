"""Operators on single documents against plain versions of themselves."""

import hashlib
import math

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from haulcomp.llm import chat, common, quality, unigram
from haulcomp.llm import vocabulary as V

from .conftest import words


@pytest.fixture(scope="module")
def documents(spark):
    return common.table(spark, SF, "documents")


def plain_statistics(text):
    text = text or ""
    w = words(text, lower=False)
    grams, lines, seen, dup = {}, text.split("\n"), set(), 0
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics(documents, odd):
    both = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = quality.judge(both, None, ["doc_id", "text"]).toPandas()
    for r in got.itertuples():
        n = plain_statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed)


def test_trees_part_good_from_bad_and_are_monotone(spark, documents):
    labels = common.table(spark, SF, "labels")
    trees = quality.train(documents, labels)
    got = quality.judge(documents, trees, ["doc_id"]).join(labels, "doc_id").filter("NOT base_failed").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.95
    rng = np.random.default_rng(1)
    x = rng.random((500, len(quality.FEATURES)))
    x[:, 0] *= 1000
    for f, sign in enumerate(quality.FEATURES.values()):
        if sign:
            up = x.copy()
            up[:, f] += rng.random(500)
            assert (sign * (trees.score(up) - trees.score(x)) >= 0).all()


def test_boosting_beats_the_mean_held_out():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = (x[:, 1] + rng.normal(0, 0.1, 4000) > x[:, 2]).astype(float)
    trees = quality.fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert quality.fit(x, np.ones(4000)) is None


def test_quality_keeps_columns_and_survives_no_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    kept = quality.keep_good(odd, none)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} <= {5, 6, 7, None}
    assert quality.keep_good(odd.limit(0), none).count() == 0


def plain_tokens(word, scores):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        found = [(best[i - 1][0] + n * unigram.BYTE_SCORE, -best[i - 1][1] - n)]
        found += [(best[j][0] + scores[word[j:i]], -best[j][1] - 1) for j in range(i) if word[j:i] in scores]
        s, c = max(found)
        best.append((s, -c))
    return best[-1]


def test_token_counts(documents, odd):
    scores = unigram.piece_scores(unigram.PIECES)
    both = documents.limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = {}
    for r in both.collect():
        found = [plain_tokens(unigram.MARK + w, scores) for w in words(r.text, lower=False)]
        texts.setdefault(r.doc_id, set()).add((len(found), sum(c for _, c in found), round(math.fsum(s for s, _ in found), 6)))
    for r in unigram.token_counts(both).collect():
        assert (r.n_words, r.n_tokens, round(r.score, 6)) in texts[r.doc_id]


def test_a_trie_started_anew_counts_alike(monkeypatch):
    scores = {"▁": -1.0, "a": -2.0, "▁a": -2.5, "ab": -2.0, "b": -3.0}
    trie = unigram.Trie(scores)
    want = [trie.word(w) for w in ("a", "ab", "abab", "ba", "é")]
    monkeypatch.setattr(unigram, "NODES", 2)
    small = unigram.Trie(scores)
    assert [small.word(w) for w in ("a", "ab", "abab", "ba", "é")] == want
    assert want[0] == (1, -2.5)


@pytest.mark.parametrize("text", ["", " ", "a  b", "a \n b", " lead", "trail ", "it's 12 x3   é漢", "\t\n\n x"])
def test_pieces_encode_like_the_whole(text):
    bpe = V.byte_bpe(V.BYTE_BPE)
    ids = np.frombuffer(bpe.pack(text), bpe.dtype)
    assert list(ids) == bpe.bpe.encode_ordinary(text)
    assert bpe.text(ids) == text


pieces = st.sampled_from([*chat.CONTROL, "\\", "<", "[", "<\\s>", "[\\\\INST]", "é", " ", "\n"]) | st.text(max_size=3)


@settings(max_examples=500, deadline=None)
@given(st.lists(pieces, max_size=8).map("".join))
def test_escape_is_reversible_and_leaves_no_control(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


def test_chats_read_back(spark):
    rows = [
        (1, 0, "system", "be [INST] kind"), (1, 1, "user", "hi <s>"), (1, 2, "assistant", "a</s>b"), (1, 3, "assistant", ""),
        (2, 0, None, "who"), (2, 1, "tool <|text|>", None), (2, None, "user", "first"), (None, 0, "assistant", "lost"),
        (3, 0, "user", "</s>[INST] ok [/INST]"), (3, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "assistant", ""),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, ids string")
    turns = chat.format_chats(table)
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    for conv in (1, 2, 3, None):
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(mine), len(learned))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    # Places are prefix sums over the turns of a conversation.
    at = {}
    for r in turns.collect():
        assert r.first == at.get(r.conv_id, 0) and len(r.ids) == len(r.mask)
        at[r.conv_id] = r.first + len(r.ids)
    assert chat.digests(chat.format_chats(table.limit(0))).count() == 0


def test_long_runs_of_white_space_have_the_ids_of_the_whole_text(monkeypatch):
    import random
    import re

    rng = random.Random(1)
    bpe = V.byte_bpe(V.BYTE_BPE)
    long_ = [" " * 2_000_000, "\n" * 2_000_000 + "x", "a b" + " \n" * 1_000_000 + "c", "a" * 2_000_000]
    for t in long_:
        assert bpe.text(np.frombuffer(bpe.pack(t), bpe.dtype)) == t
    monkeypatch.setattr(V, "LONG", 5)
    monkeypatch.setattr(V, "_RUN", re.compile(f"{V._SPACES}{{5,}}"))
    parts = ["  ", "\n", " ", "a", "b'", "s", "\u3000", "\x1c", "9", "!", "     ", "\t", "\u2003"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert bpe.pack(t) == np.array(bpe.bpe.encode_ordinary(t), bpe.dtype).tobytes(), repr(t)


def test_texts_have_the_ids_of_the_tokenizer(documents, odd, monkeypatch):
    bpe = V.ByteBpe(V.BYTE_BPE)
    texts = [r.text or "" for df in (documents, odd) for r in df.select("text").collect()] + ["", " ", " a", "a ", "a  b", "a", "", "é漢", "\x00 \x00"]
    want = [np.array(bpe.bpe.encode_ordinary(t), bpe.dtype).tobytes() for t in texts]
    assert [bpe.pack(t) for t in texts] == want
    monkeypatch.setattr(V, "REMEMBERED", 3)
    assert [bpe.pack(t) for t in texts[:50]] == want[:50]


def test_long_words_are_scored_without_nodes(monkeypatch):
    import random

    rng = random.Random(2)
    scores = unigram.piece_scores(unigram.PIECES)
    words_ = ["".join(rng.choice("abcdeé漢tionsing") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    whole = unigram.Trie(scores)
    want = [whole.word(w) for w in words_]
    for long_ in (1, 4, 30):
        monkeypatch.setattr(unigram, "LONG", long_)
        trie = unigram.Trie(scores)
        assert [trie.word(w) for w in words_] == want
    monkeypatch.setattr(unigram, "LONG", 1_000)
    trie = unigram.Trie(scores)
    assert trie.word("ab" * 1_000_000)[0] == 1_000_000 and len(trie.best) < 1_100
