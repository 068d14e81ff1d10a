"""Public tokenizer vocabularies inside tasks, loaded once per worker; their place is a parameter."""

from __future__ import annotations

import base64
import re

import numpy as np

FOLDER = "/opt/tokenizers"
BYTE_BPE = f"{FOLDER}/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the byte-level vocabularies split text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of text remembered by a worker before it starts anew.
REMEMBERED = 400_000
_SPLIT = re.compile(r"(?= [^\s])")
_ODD = re.compile(r" (?=\s|$)")
#: Characters of white space in a row that are not left to the pattern, whose engine runs out of stack on them.
LONG = 100_000
#: Fixed value: what the pattern takes for white space.
_SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN = re.compile(f"{_SPACES}{{{LONG},}}")


class ByteBpe:
    """Byte-level BPE whose pieces (a space and what follows it) are encoded once and remembered.

    The vocabulary's pattern always breaks before a space that a non-space follows, so pieces cut
    there give the same ids as the whole text.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if self.size < 60_000 else "<u4")
        self.known: dict[str, bytes] = {}
        #: The same for pieces of a space and a word, by the word.
        self.spaced: dict[str, bytes] = {}

    def pack(self, text: str) -> bytes:
        """The ids of a text, as bytes of ``dtype``.

        In a run of white space the pattern makes one piece of all but the last character, which it leaves to what
        follows, or of all of it at the end of the text. Long runs are cut off that way here, as one piece each.
        """
        if len(text) < LONG or not _RUN.search(text):
            return self._pack(text)
        out, at = [], 0
        for run in _RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            piece = self.bpe._encode_single_piece(text[run.start() : end])
            out += [self._pack(text[at : run.start()]), np.array(piece, self.dtype).tobytes()]
            at = end
        return b"".join([*out, self._pack(text[at:])])

    def _pack(self, text: str) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if _ODD.search(text):
            return b"".join([self._piece(self.known, p, p) for p in _SPLIT.split(text)])
        first, *words = text.split(" ")
        head, spaced = self._piece(self.known, first, first), self.spaced
        try:
            return head + b"".join(map(spaced.__getitem__, words))
        except KeyError:
            if len(spaced) > REMEMBERED:
                spaced.clear()
            for w in words:
                if w not in spaced:
                    self._piece(spaced, w, " " + w)
            return head + b"".join(map(spaced.__getitem__, words))

    def _piece(self, known: dict[str, bytes], key: str, piece: str) -> bytes:
        got = known.get(key)
        if got is None:
            got = known[key] = np.array(self.bpe.encode_ordinary(piece), self.dtype).tobytes()
        return got

    def text(self, ids) -> str:
        return self.bpe.decode([int(i) for i in ids])


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def known_size(path: str) -> int:
    """Number of ids of a byte-level vocabulary file."""
    return byte_bpe(path).size
