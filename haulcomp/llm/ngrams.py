"""A smoothed trigram model in an Elias-Fano trie, trained and queried in Spark.

Words are counted over all training documents, then n-grams of two and three words. n-grams seen less than ``cutoff`` times are
left out: the query's cutoff is 1, so it learns from all of them; ``train_model`` alone leaves out those seen once. A trigram is
only looked at where both of its bigrams were kept, which loses none. What an n-gram's discount sets free goes to the shorter history, normalised over the words not kept, so probabilities
sum to one over the vocabulary and one unknown word.

The trie is written in shards by the first word's hash. A level holds, per context, a monotone pointer to where its
children begin (Elias-Fano: one bit per child and context, a directory of ones), the children's word numbers in order within
their context, packed to the bits of the vocabulary, and log10 probabilities and back-off weights in 16 bits. Shards are
files in the shared folder that tasks map into memory; a query selects the pointers of its
context and searches the word between them from where its number lets expect it, for all distinct n-grams of a slice at once, in order.
Shards grow in number with the training tokens (``SHARD_TOKENS`` each), so no task holds the counts of the corpus. They stand
one after the other in at most ``FILES`` files, each searched at once, so that a slice's cost doesn't grow with their number.

Texts are split at white space after lower-casing A-Z, and end with one end token. Null or empty texts are
the end token alone. Rows are independent when scored; repeated rows count as often as they stand when trained. A
missing id counts as the empty text in the rule that holds documents out. Without training documents every token is
unknown. Extra columns are not looked at.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcomp.llm import common as C
from haulcomp.llm.jaccard import sorted_groups

#: The least count of an n-gram that is kept unless the caller says otherwise (the query keeps all).
CUTOFF, DISCOUNT = 2, 0.75
#: Training tokens per shard; codes gathered in a task before they are summed; steps per unit of log10.
SHARD_TOKENS, GATHER, STEPS = 4_000_000, 4_000_000, 2048
#: Files of a level.
FILES = 64
END_HASH = 0x5BF03635F0A2D1E7
UNKNOWN = -1


# ---- packed arrays --------------------------------------------------------------------------


def pack_ints(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers in ``bits`` bits each, with eight bytes to spare at the end."""
    # 64 numbers fill ``bits`` whole words; the numbers at the same place among their 64 are shifted at once.
    rows = -(-len(x) // 64)
    column = np.zeros(rows * 64, C.U)
    column[: len(x)] = x
    column = np.ascontiguousarray(column.reshape(-1, 64).T)
    out = np.zeros((bits, rows), C.U)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[word] |= column[j] << C.U(shift)
        if shift + bits > 64:
            out[word + 1] |= column[j] >> C.U(64 - shift)
    flat = np.ascontiguousarray(out.T).view(np.uint8).ravel()[: -(-len(x) * bits // 8)]
    return np.concatenate([flat, np.zeros(8, np.uint8)])


def unpack_at(packed: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The numbers at the given places."""
    bit = at * bits
    wide = np.ndarray(len(packed) - 7, "<u8", packed, 0, (1,))
    return ((wide[bit >> 3] >> (bit & 7).astype(C.U)) & C.U((1 << bits) - 1)).astype(np.int64)


def ef_build(pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone pointers as ones in a bit vector (pointer i is the number of zeros before its one), and ones before each 64 bits."""
    n = len(pointers)
    size = int(pointers[-1]) + n + 1
    flags = np.zeros(-(-size // 64) * 64, bool)
    flags[pointers + np.arange(n)] = True
    words = np.packbits(flags, bitorder="little").view("<u8")
    ones = np.bitwise_count(words)
    return words, (np.cumsum(ones, dtype=np.int64) - ones).astype(np.uint32 if n < 1 << 32 else np.int64)


#: Place of the one with rank r in byte b, at 8 * b + r.
_IN_BYTE = np.zeros(2048, np.int64)
for _b in range(256):
    _places = [j for j in range(8) if _b >> j & 1]
    _IN_BYTE[8 * _b : 8 * _b + len(_places)] = _places
_EACH = 0x0101010101010101


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one with the given rank in each 64-bit word."""
    ones = word - ((word >> C.U(1)) & C.U(0x5555555555555555))
    ones = (ones & C.U(0x3333333333333333)) + ((ones >> C.U(2)) & C.U(0x3333333333333333))
    # In byte j, the ones of bytes 0..j.
    ones = ((ones + (ones >> C.U(4))) & C.U(0x0F0F0F0F0F0F0F0F)) * C.U(_EACH)
    rank = rank.astype(C.U)
    passed = ((rank * C.U(_EACH)) | C.U(0x80 * _EACH)) - ones
    at = np.bitwise_count(passed & C.U(0x80 * _EACH)).astype(C.U) * C.U(8)
    rank -= ((ones << C.U(8)) >> at) & C.U(0xFF)
    byte = (word >> at) & C.U(0xFF)
    return at.astype(np.int64) + _IN_BYTE[(byte * C.U(8) + rank).astype(np.int64)]


def _ef_one(words: np.ndarray, directory: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, place in it) of the ones with the given ranks."""
    at = np.searchsorted(directory, i.astype(directory.dtype), "right") - 1
    return at, _select_in_word(words[at], i - directory[at])


def ef_get(words: np.ndarray, directory: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The pointers at the given places."""
    at, place = _ef_one(words, directory, i)
    return at * 64 + place - i


def distinct(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of ``bits`` bits in order, and the place of each code among them."""
    low = len(code).bit_length()
    if bits + low > 63:
        return np.unique(code, return_inverse=True)
    # A code and where it stands are sorted as one number.
    key = np.sort((code << low) | np.arange(len(code)))
    order = key & ((1 << low) - 1)
    key >>= low
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(new) - 1
    return key[new], back


# ---- files ----------------------------------------------------------------------------------


class Writer:
    """A file of shards, one after the other; put in place as a whole, so that a second attempt of a task does no harm."""

    def __init__(self, folder: str, name: str) -> None:
        self.store, path = arrow_fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.temporary, self.path = f"{path}/.{name}-{uuid.uuid4().hex}", f"{path}/{name}"
        self.out, self.at, self.heads = self.store.open_output_stream(self.temporary), 0, []

    def add(self, arrays: dict[str, np.ndarray]) -> None:
        head = {}
        for key, a in arrays.items():
            raw = np.ascontiguousarray(a).tobytes()
            head[key] = (str(a.dtype), self.at, len(a))
            raw += bytes(-len(raw) % 8)
            self.out.write(raw)
            self.at += len(raw)
        self.heads.append(head)

    def close(self) -> None:
        top = json.dumps(self.heads).encode()
        top += b" " * (-len(top) % 8)
        self.out.write(top)
        self.out.write(len(top).to_bytes(8, "little"))
        self.out.close()
        self.store.move(self.temporary, self.path)


class File:
    """The arrays of each shard of a mapped file, and the file as one array with the bytes at which they begin."""

    def __init__(self, data: mmap.mmap) -> None:
        top = int.from_bytes(data[-8:], "little")
        heads = json.loads(data[-8 - top : -8])
        self.shards = [{k: np.frombuffer(data, t, n, at) for k, (t, at, n) in head.items()} for head in heads]
        self.begin = {k: np.array([head[k][1] for head in heads]) for k in heads[0]}
        self.words, self.shorts = np.frombuffer(data, "<u8"), np.frombuffer(data, "<i2")
        # Eight bytes from any byte on.
        self.wide = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))

    def short(self, key: str, shard: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.shorts[(self.begin[key][shard] >> 1) + at]

    def unpack(self, key: str, shard: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
        bit = at * bits
        return ((self.wide[self.begin[key][shard] + (bit >> 3)] >> (bit & 7).astype(C.U)) & C.U((1 << bits) - 1)).astype(np.int64)

    def _one(self, shard: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, its bits, place in it) of the ones with the given ranks."""
        at, rank = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(i)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            if lo < hi:
                directory = self.shards[shard[lo]]["before"]
                found = np.searchsorted(directory, i[lo:hi].astype(directory.dtype), "right") - 1
                at[lo:hi], rank[lo:hi] = found, directory[found]
        word = self.words[(self.begin["ones"][shard] >> 3) + at]
        return at, word, _select_in_word(word, i - rank)

    def ranges(self, shard: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pointers at the given places of shards, and at the places after them."""
        at, word, place = self._one(shard, i)
        begin = at * 64 + place - i
        # Zeros up to the next one, which mostly stands in the same word.
        rest = (word >> place.astype(C.U)) >> C.U(1)
        end = begin + np.bitwise_count((rest & -rest) - C.U(1))
        far = np.flatnonzero(rest == 0)
        at, _, place = self._one(shard[far], i[far] + 1)
        end[far] = at * 64 + place - i[far] - 1
        return begin, end


_mapped: dict[tuple[str, str], File] = {}


def load(folder: str, name: str) -> File:
    """A file, mapped into memory once per worker; one that isn't local is copied beside the worker first."""
    key = (folder, name)
    if key not in _mapped:
        store, path = arrow_fs.FileSystem.from_uri(folder)
        local = f"{path}/{name}"
        if not isinstance(store, arrow_fs.LocalFileSystem):
            with tempfile.NamedTemporaryFile(delete=False) as copy, store.open_input_stream(local) as source:
                while chunk := source.read(1 << 22):
                    copy.write(chunk)
            local = copy.name
        with open(local, "rb") as f:
            _mapped[key] = File(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        if local != f"{path}/{name}":
            os.unlink(local)
    return _mapped[key]


@dataclass(frozen=True)
class Model:
    """Where the shards are, and their sizes: first word number, and first bigram number, of each."""

    folder: str
    shards: int
    tokens: int
    words: np.ndarray
    bigrams: np.ndarray | None = None

    @property
    def size(self) -> int:
        """Distinct training tokens; also the number of the start, a context only."""
        return int(self.words[-1])

    @property
    def bits(self) -> int:
        return max(1, int(self.size).bit_length())

    @property
    def per_file(self) -> int:
        return max(1, self.shards // FILES)

    def level(self, kind: str, shard: int) -> dict[str, np.ndarray]:
        """The arrays of a shard."""
        return load(self.folder, f"{kind}-{shard // self.per_file}").shards[shard % self.per_file]

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> C.U(65 - self.shards.bit_length())).astype(np.int64) if self.shards > 1 else np.zeros(len(hashes), np.int64)

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        # Short numbers are sorted by radix.
        order = np.argsort(shard.astype(np.min_scalar_type(self.shards)), kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cut):
            if len(part):
                yield int(shard[part[0]]), part

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, UNKNOWN for words not seen in training; numbers are in the order of the hashes."""
        out = np.full(len(hashes), UNKNOWN, np.int64)
        for s, part in self._by_shard(self.shard_of(hashes)):
            known = self.level("words", s)["hash"]
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[part]), len(known) - 1)
                hit = known[at] == hashes[part]
                out[part[hit]] = self.words[s] + at[hit]
        return out

    def word_shard(self, word: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.words, word, "right") - 1, self.shards - 1)

    def counts(self, word: np.ndarray) -> np.ndarray:
        """Training count of each word number; 0 for UNKNOWN."""
        out = np.zeros(len(word), np.int64)
        known = np.flatnonzero((word >= 0) & (word < self.size))
        for s, part in self._by_shard(self.word_shard(word[known])):
            out[known[part]] = self.level("words", s)["count"][word[known[part]] - self.words[s]]
        return out

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.size + 1))

    def bigram(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the bigrams (u, v), UNKNOWN where none is kept; the number with which those of u begin), for bigrams in order."""
        number, begin = np.full(len(u), UNKNOWN, np.int64), np.full(len(u), UNKNOWN, np.int64)
        use = np.flatnonzero((u >= 0) & (v >= 0))
        shard = self.word_shard(u[use])
        for f, part in self._by_shard(shard // self.per_file):
            at, s = use[part], shard[part]
            got, first = children(load(self.folder, f"bigrams-{f}"), s % self.per_file, u[at] - self.words[s], v[at], self.bits, self.size)
            number[at] = np.where(got >= 0, got + self.bigrams[s], UNKNOWN)
            begin[at] = first + self.bigrams[s]
        return number, begin

    def bigrams_of(self, ids: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each token's bigram among the distinct ones, which are in order; ``bigram`` of those). Tokens are places in ``ids``."""
        bits = len(ids).bit_length()
        code, of = distinct((before(at, bounds, len(ids)) << bits) | at, 2 * bits)
        return of, *self.bigram(np.append(ids, self.size)[code >> bits], ids[code & ((1 << bits) - 1)])

    def begins(self, u: np.ndarray) -> np.ndarray:
        """The number with which the bigrams of each word begin."""
        one, back = distinct(u, self.bits)
        out = np.zeros(len(one), np.int64)
        for s, part in self._by_shard(self.word_shard(one)):
            level = self.level("bigrams", s)
            out[part] = ef_get(level["ones"], level["before"], one[part] - self.words[s]) + self.bigrams[s]
        return out[back]

    def trigram(self, pair: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability or nan, log10 back-off) of w after each bigram number, for trigrams in order."""
        prob, back = np.full(len(pair), np.nan), np.zeros(len(pair))
        shard = self.pair_shard(pair)
        for f, part in self._by_shard(shard // self.per_file):
            file, s = load(self.folder, f"trigrams-{f}"), shard[part]
            own, s = pair[part] - self.bigrams[s], s % self.per_file
            back[part] = file.short("back", s, own) / STEPS
            got = children(file, s, own, w[part], self.bits, self.size)[0]
            hit = np.flatnonzero(got >= 0)
            prob[part[hit]] = file.short("prob", s[hit], got[hit]) / STEPS
        return prob, back

    def pair_shard(self, pair: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bigrams, pair, "right") - 1

    def of_pairs(self, pair: np.ndarray, *what: str) -> list[np.ndarray]:
        """Stored values of each bigram number."""
        out = [np.zeros(len(pair), np.int64) for _ in what]
        for s, part in self._by_shard(self.pair_shard(pair)):
            level, own = self.level("bigrams", s), pair[part] - self.bigrams[s]
            for values, name in zip(out, what):
                values[part] = unpack_at(level["word"], own, self.bits) if name == "word" else level[name][own]
        return out

    def word_backoff(self, u: np.ndarray) -> np.ndarray:
        out = np.zeros(len(u))
        use = np.flatnonzero(u >= 0)
        for s, part in self._by_shard(self.word_shard(u[use])):
            out[use[part]] = self.level("bigrams", s)["back"][u[use[part]] - self.words[s]] / STEPS
        return out

    def two(self, pair: np.ndarray, v: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """log10 p(w | v) from the bigram numbers of (v, w), backing off to the word's own share."""
        out = np.zeros(len(pair))
        hit, miss = np.flatnonzero(pair >= 0), np.flatnonzero(pair < 0)
        out[hit] = self.of_pairs(pair[hit], "prob")[0] / STEPS
        out[miss] = self.word_backoff(v[miss]) + alone[miss]
        return out

    def three(self, ids: np.ndarray, at: np.ndarray, bounds: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """log10 p(w | u, v) of consecutive tokens, no u at a first one; ``alone`` are the words' own shares. Tokens are places in ``ids``."""
        of, pair, _ = self.bigrams_of(ids, at, bounds)
        history = histories_of(of, bounds[:-1])
        use = np.flatnonzero((history >= 0) & (pair[history] >= 0))
        bits = len(ids).bit_length()
        code, place = distinct((history[use] << bits) | at[use], len(pair).bit_length() + bits)
        found, off = self.trigram(pair[code >> bits], ids[code & ((1 << bits) - 1)])
        prob, back = np.full(len(at), np.nan), np.zeros(len(at))
        prob[use], back[use] = found[place], off[place]
        miss = np.flatnonzero(np.isnan(prob))
        v = np.append(ids, self.size)[before(at, bounds, len(ids))[miss]]
        prob[miss] = back[miss] + self.two(pair[of[miss]], v, alone[at[miss]])
        return prob


def histories_of(pair: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bigram before each token."""
    out = np.roll(pair, 1)
    out[starts] = UNKNOWN
    return out


def children(file: File, shard: np.ndarray, context: np.ndarray, word: np.ndarray, bits: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the words among the children of their contexts in shards of a file, -1 where they are none; where those children begin).

    A search between two pointers. Words are numbered below ``size`` by their hashes, so a context's children lie evenly and a
    word's place is guessed from its number; every fourth step halves, whatever the numbers.
    """
    # Words come in order of their contexts: the pointers of a context are read once.
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (shard[1:] != shard[:-1])
    of = np.cumsum(new) - 1
    begin, end = (p[of] for p in file.ranges(shard[new], context[new]))
    out = np.full(len(context), -1, np.int64)
    row = np.flatnonzero((begin < end) & (word >= 0))
    lo, hi, want, shard = begin[row], end[row], word[row], shard[row]
    # The children from lo to before hi are numbered from least to most.
    least, most, step = np.zeros(len(row), np.int64), np.full(len(row), size, np.int64), 0
    while len(row):
        step += 1
        if step % 4:
            mid = lo + ((want - least) * ((hi - lo) / (most - least + 1))).astype(np.int64)
        else:
            mid = (lo + hi) >> 1
        got = file.unpack("word", shard, mid, bits)
        hit = got == want
        out[row[hit]] = mid[hit]
        less = got < want
        lo, least = np.where(less, mid + 1, lo), np.where(less, got + 1, least)
        hi, most = np.where(less, hi, mid), np.where(less, most, got - 1)
        left = np.flatnonzero((lo < hi) & ~hit & (want >= least) & (want <= most))
        row, shard, lo, hi, want, least, most = (x[left] for x in (row, shard, lo, hi, want, least, most))
    return out, begin


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(log10 * STEPS), -32767, 32767).astype(np.int16)


# ---- training -------------------------------------------------------------------------------


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(7)) == 2


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of a slice, an end after each document; first token of each document and the total)."""
    # Bytes A-Z are 32 below a-z.
    buf = buf + ((buf - np.uint8(ord("A")) < 26).view(np.uint8) << 5)
    starts, ends, first = C.words(buf, off)
    h = C.span_hash(C.prefix_sums(buf), starts, ends)
    bounds = first + np.arange(len(first))
    out = np.full(int(bounds[-1]), END_HASH, C.U)
    of_word = np.ones(len(out), bool)
    of_word[bounds[1:] - 1] = False
    out[of_word] = h
    return out, bounds


def before(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The token before each token."""
    out = np.roll(ids, 1)
    out[bounds[:-1]] = start
    return out


def looked_up(model: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the distinct words of a slice, in the order of their hashes; place among them of each token; first tokens and the total)."""
    h, bounds = tokens(buf, off)
    coded = pa.array(h).dictionary_encode()
    word = coded.dictionary.to_numpy()
    order = np.argsort(word)
    rank = np.empty(len(word), np.int64)
    rank[order] = np.arange(len(word))
    return model.number(word[order]), rank[coded.indices.to_numpy()], bounds


def _summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of distinct codes and their counts as one, in order."""
    code = np.sort(np.concatenate([c for c, _ in runs]))
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    code = code[new]
    n = np.zeros(len(code), np.int64)
    for c, m in runs:
        n[np.searchsorted(code, c)] += m
    return code, n


def count_words(train: DataFrame) -> DataFrame:
    """(hash, n) over all training documents."""

    def run(it):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for batch in it:
            for _, _, buf, off in C.text_slices(batch.column(0)):
                held.append(tokens(buf, off)[0])
                size += len(held[-1])
                if size > GATHER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return C.map_arrow(train.select("text"), run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def _per_shard(rows: DataFrame, order: list[str], write, spark: SparkSession, folder: str, kind: str, shards: int) -> np.ndarray:
    """Write the arrays of ``write(shard, table)`` for each shard's rows; returns where each shard's numbers (as many as ``write`` says) begin, and the total."""
    per = max(1, shards // FILES)

    def run(it):
        file = None
        for t in sorted_groups(it, 1):
            s = t.column(0)[0].as_py()
            file = file or Writer(folder, f"{kind}-{s // per}")
            arrays, n = write(s, t)
            file.add(arrays)
            if (s + 1) % per == 0:
                file.close()
                file = None
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([n], pa.int64())], names=["shard", "n"])

    # A row without content for each shard, so that every shard stands in its file.
    none = spark.range(shards).select(F.col("id").cast("int").alias("shard"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:]])
    spread = rows.unionByName(none).repartition(min(shards // per, C.parts_of(spark)), F.floor(F.col("shard") / per)).sortWithinPartitions("shard", *order)
    sizes = {r.shard: r.n for r in C.map_arrow(spread, run, "shard int, n bigint").collect()}
    return np.concatenate([[0], np.cumsum([sizes[s] for s in range(shards)])]).astype(np.int64)


def _codes(train: DataFrame, model: Model, first: np.ndarray, code_of) -> DataFrame:
    """(shard, codes, counts): sorted distinct n-gram codes of a task with their counts, compressed, by shard; ``first`` is each shard's least code."""

    def run(it):
        zip_ = zstandard.ZstdCompressor(level=3)
        held, size = [], 0

        def flush():
            code, count = np.unique(np.concatenate(held), return_counts=True)
            cut = np.append(np.searchsorted(code, first), len(code))
            rows = []
            for s in np.flatnonzero(np.diff(cut)):
                c, n = code[cut[s] : cut[s + 1]], count[cut[s] : cut[s + 1]]
                # Bytes of equal weight stand together, which packs them closer.
                steps = np.diff(c, prepend=np.zeros(1, C.U)).view(np.uint8).reshape(-1, 8).T
                rows.append((s, zip_.compress(steps.tobytes()), zip_.compress(n.astype("<u4").tobytes())))
            shards, codes, counts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), C.blobs(codes), C.blobs(counts)], names=["shard", "codes", "counts"])

        for batch in it:
            for _, _, buf, off in C.text_slices(batch.column(0)):
                held.append(code_of(*looked_up(model, buf, off)))
                size += len(held[-1])
                if size > GATHER:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return C.map_arrow(train.select("text"), run, "shard int, codes binary, counts binary")


def _gathered(t: pa.Table, cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a shard with their counts, those below the cutoff left out."""
    unzip = zstandard.ZstdDecompressor()
    runs, size = [(np.zeros(0, C.U), np.zeros(0, np.int64))], 0
    for c, m in zip(t.column("codes"), t.column("counts")):
        if c.is_valid:
            steps = np.ascontiguousarray(np.frombuffer(unzip.decompress(c.as_py()), np.uint8).reshape(8, -1).T).view(C.U).ravel()
            runs.append((np.cumsum(steps, dtype=C.U), np.frombuffer(unzip.decompress(m.as_py()), "<u4")))
            size += len(steps)
            # As many codes again as are summed already, so that a large shard isn't summed run by run.
            if size > max(GATHER, len(runs[0][0])):
                runs, size = [_summed(runs)], 0
    code, n = _summed(runs)
    return code[n >= cutoff], n[n >= cutoff]


def _level(context: np.ndarray, contexts: int, word: np.ndarray, n: np.ndarray, total: np.ndarray, lower: np.ndarray, bits: int) -> dict[str, np.ndarray]:
    """The arrays of a level: children sorted by (context, word); ``total`` per context, log10 ``lower`` order share per child."""
    begin = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=contexts))])
    ones, before = ef_build(begin)
    share = (n - DISCOUNT) / total[context] if len(n) else np.zeros(0)
    kept = np.bincount(context, share, contexts)
    below = np.bincount(context, 10.0**lower, contexts) if len(n) else np.zeros(contexts)
    back = np.log10(np.maximum(1 - kept, 1e-12) / np.maximum(1 - below, 1e-12))
    return {"ones": ones, "before": before, "word": pack_ints(word, bits), "prob": quantised(np.log10(share)), "back": quantised(back)}


def train_model(docs: DataFrame, folder: str, cutoff: int = CUTOFF) -> Model:
    """Train on all rows of ``docs`` and write the trie, of n-grams seen ``cutoff`` times or more, under ``folder``."""
    spark = docs.sparkSession
    words = C.stage(count_words(docs), "word-counts")
    total = int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    n_docs = docs.count()
    shards = 8
    while shards * SHARD_TOKENS < total:
        shards *= 2
    # Unsigned order of hashes: flip the sign bit of the signed number.
    top = F.shiftrightunsigned("hash", 65 - shards.bit_length()).cast("int")
    rows = words.select(top.alias("shard"), F.col("hash").bitwiseXOR(F.lit(-(2**63))).alias("_order"), "hash", "n")

    def write_words(s: int, t: pa.Table) -> tuple[dict[str, np.ndarray], int]:
        t = t.filter(t.column("hash").is_valid())
        return {"hash": t.column("hash").to_numpy().view(C.U), "count": t.column("n").to_numpy()}, t.num_rows

    model = Model(folder, shards, total, _per_shard(rows, ["_order"], write_words, spark, folder, "words", shards))
    base = model.size + 1

    def pairs(ids, at, bounds):
        v = np.append(ids, model.size)[before(at, bounds, len(ids))]
        return v.astype(C.U) * C.U(base) + ids[at].astype(C.U)

    def write_bigrams(s: int, t: pa.Table) -> tuple[dict[str, np.ndarray], int]:
        code, n = _gathered(t, cutoff)
        first, last = int(model.words[s]), int(model.words[s + 1]) + (s == shards - 1)
        context, word = (code // C.U(base)).astype(np.int64) - first, (code % C.U(base)).astype(np.int64)
        seen = model.counts(np.arange(first, last))
        if s == shards - 1:
            seen[-1] = n_docs
        level = _level(context, last - first, word, n, seen, model.unigram(model.counts(word)), model.bits)
        # Trigrams are shares of their bigram's count, in as many bytes as the greatest needs.
        return level | {"count": n.astype(np.min_scalar_type(int(n.max(initial=0))))}, len(n)

    bigrams = _per_shard(_codes(docs, model, model.words[:-1].astype(C.U) * C.U(base), pairs), [], write_bigrams, spark, folder, "bigrams", shards)
    full = Model(folder, shards, total, model.words, bigrams)

    def triples(ids, at, bounds):
        # The last word by the place of its bigram among those of the middle word, so that the bigram needn't be searched again.
        of, pair, begin = full.bigrams_of(ids, at, bounds)
        first = histories_of(pair[of], bounds[:-1])
        last = (pair - begin)[of]
        use = np.flatnonzero((pair[of] >= 0) & (first >= 0))
        return first[use].astype(C.U) * C.U(base) + last[use].astype(C.U)

    def write_trigrams(s: int, t: pa.Table) -> tuple[dict[str, np.ndarray], int]:
        code, n = _gathered(t, cutoff)
        first, last = int(full.bigrams[s]), int(full.bigrams[s + 1])
        context, place = (code // C.U(base)).astype(np.int64) - first, (code % C.U(base)).astype(np.int64)
        seen, middle = full.of_pairs(np.arange(first, last), "count", "word")
        word, lower = full.of_pairs(full.begins(middle)[context] + place, "word", "prob")
        return _level(context, last - first, word, n, seen, lower / STEPS, full.bits), len(n)

    _per_shard(_codes(docs, full, bigrams[:-1].astype(C.U) * C.U(base), triples), [], write_trigrams, spark, folder, "trigrams", shards)
    return full


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = C.fields(f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

    def run(it):
        for batch in it:
            for lo, hi, buf, off in C.text_slices(batch.column(0)):
                ids, at, bounds = looked_up(model, buf, off)
                count = model.counts(ids)
                alone = model.unigram(count)
                own = model.three(ids, at, bounds, alone)
                known, base, own = (np.add.reduceat(x, bounds[:-1]) for x in ((count > 0).astype(np.int64)[at], alone[at], own))
                n = hi - lo
                yield C.batches(schema, batch.column(1).slice(lo, n), np.diff(bounds), known, np.full(n, model.tokens), base, own)

    return C.map_arrow(docs.select(docs["text"], docs["doc_id"]), run, schema)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_model(docs.filter(~held_out(F.col("doc_id"))), C.fresh_folder(spark, "ngrams"), cutoff=1)
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
