"""Token counts under a unigram model, by dynamic programming over a trie.

A text's words, each with the word mark before it, are cut into pieces of a public vocabulary so that the sum of the
pieces' scores is largest. Distinct words are put in a trie; a trie node holds the best score of
its prefix and the number of pieces in it, which depend on the path to it alone, so a prefix shared by many words is
scored once, and a word's count is read at its terminal. Each task grows a trie of its own over all its texts
and starts a new one beyond ``NODES`` nodes. A word of more than ``LONG`` characters shares no more than that much of a
trie: its first ``LONG`` characters are nodes, and from there its scores are kept for the length of the longest
piece only. So memory is bounded, by the text at hand and ``NODES`` nodes, and counts don't depend on it.

Piece scores are log-probabilities by rank (vocabulary files hold an order, no frequencies). A character that no piece covers
costs one token per UTF-8 byte. Ties go to fewer pieces.

Null and empty texts have no tokens. Rows are independent; repeated rows repeat; an empty table stays
empty. A kept column that has the name of an output gives way to it.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from haulcomp.llm import common as C
from haulcomp.llm import vocabulary as V

PIECES = f"{V.FOLDER}/piece_bpe_32k.model"
MARK = "▁"
#: Score of one byte of a character outside the vocabulary.
BYTE_SCORE = -20.0
NODES = 1_000_000
#: Characters of a word that become nodes of the trie.
LONG = 1_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")


def piece_scores(path: str) -> dict[str, float]:
    """Piece to score: the log of a rank's share when shares fall as 1 / rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(usual))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(usual)}


class Trie:
    """Prefixes of words with the best score and piece count of each."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.best, self.count = [0.0], [0]
        self.terminal: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of a word."""
        got = self.terminal.get(word)
        if got is None:
            if len(self.best) > NODES:
                self.clear()
            if len(word) > LONG:
                return self._long(MARK + word)
            got = self.terminal[word] = self._insert(MARK + word)
        return got

    def _long(self, text: str) -> tuple[int, float]:
        """``_insert`` of a long text: its prefix in the trie, then a window of scores as wide as the longest piece."""
        self._insert(text[:LONG])
        node, near = 0, [(self.best[0], self.count[0])]
        for char in text[:LONG]:
            node = self.kids[node][char]
            near.append((self.best[node], self.count[node]))
        near = near[-self.longest :]
        for depth in range(LONG + 1, len(text) + 1):
            size = len(text[depth - 1].encode())
            score, count = near[-1][0] + size * BYTE_SCORE, near[-1][1] + size
            for length in range(1, min(self.longest, len(near)) + 1):
                own = self.scores.get(text[depth - length : depth])
                if own is not None:
                    s, c = near[-length][0] + own, near[-length][1] + 1
                    if s > score or (s == score and c < count):
                        score, count = s, c
            near.append((score, count))
            if len(near) > 2 * self.longest:
                del near[: -self.longest]
        return near[-1][1], near[-1][0]

    def _insert(self, text: str) -> tuple[int, float]:
        node, path = 0, [0]
        for depth, char in enumerate(text, 1):
            child = self.kids[node].get(char)
            if child is None:
                child = len(self.best)
                self.kids[node][char] = child
                self.kids.append({})
                score, count = self._forward(text, depth, path)
                self.best.append(score)
                self.count.append(count)
            node = child
            path.append(node)
        return self.count[node], self.best[node]

    def _forward(self, text: str, depth: int, path: list[int]) -> tuple[float, int]:
        """Best (score, fewest pieces) of text[:depth], from its prefixes on the path."""
        size = len(text[depth - 1].encode())
        before = path[depth - 1]
        score, count = self.best[before] + size * BYTE_SCORE, self.count[before] + size
        for length in range(1, min(depth, self.longest) + 1):
            own = self.scores.get(text[depth - length : depth])
            if own is not None:
                before = path[depth - length]
                s, c = self.best[before] + own, self.count[before] + 1
                if s > score or (s == score and c < count):
                    score, count = s, c
        return score, count


def token_counts(docs: DataFrame, pieces: str = PIECES) -> DataFrame:
    """doc_id, n_words, n_tokens and score (sum of the pieces' scores) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = C.fields(f"doc_id {kind}, n_words bigint, n_tokens bigint, score double")

    def run(it):
        trie = Trie(piece_scores(pieces))
        for batch in it:
            for lo in range(0, batch.num_rows, 1000):
                few = batch.slice(lo, 1000)
                words, tokens, scores = [], [], []
                for text in few.column(0).to_pylist():
                    found = (_WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()) if text else []
                    got = [trie.word(w) for w in found]
                    words.append(len(got))
                    tokens.append(sum(c for c, _ in got))
                    scores.append(math.fsum(s for _, s in got))
                yield C.batches(schema, few.column(1), np.array(words), np.array(tokens), np.array(scores))

    return C.map_arrow(docs.select(docs["text"], docs["doc_id"]), run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(C.table(spark, sf_dir, "documents"))
