"""Words as batches of equal length over a vocabulary of pieces.

Words are rows of code points. Any substring's hash comes from two prefix hashes; it is looked up among the sorted hashes of
the pieces. All words of one length take each step of a recursion together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import sentencepiece

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
LENGTH = np.uint64(0xD6E8FEB86659FD93)
SPREAD = np.uint64(0xFF51AFD7ED558CCD)
#: Code points that one batch holds, about.
BATCH = 60_000
#: So few words of one length are gone through one by one, their pieces looked up at all places at once: a step of the
#: batch costs the same for one word as for many.
FEW = 6
#: Places of a word whose pieces are looked up at once.
PLACES = 1 << 16
UNIGRAM, BPE = 1, 2
FIRST_BITS = 20


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        shift += 7
        at += 1
        if not data[at - 1] & 0x80:
            return value, at


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number and value."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        if tag & 7 == 0:
            value, at = varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = varint(data, at)
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class Pieces:
    """A SentencePiece vocabulary: pieces, scores, the model's kind, and its table of hashes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        trainer: dict = {}
        rules: dict = {}
        for n, value in message(data):
            if n == 2:
                trainer = dict(message(value))
            elif n == 3:
                rules = dict(message(value))
        self.kind = trainer.get(3, UNIGRAM)
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError(f"{path}: only models without normalisation, which keep white space, are supported")
        self.prefix = bool(rules.get(3, 1))
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.unknown = model.unk_id()
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        self.byte = np.full(256, -1, np.int64)
        plain = []
        for i, p in enumerate(self.text):
            if model.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append(i)
        self.score = np.array([model.get_score(i) for i in range(self.size)])
        self.normal = np.array(plain)
        self.is_normal = np.zeros(self.size, bool)
        self.is_normal[self.normal] = True
        self.longest = max(len(self.text[i]) for i in plain)
        keys = np.array([self.key_of(self.text[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], self.normal[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        # Where in the sorted keys those begin that share their first bits, or -1: most substrings are no piece, and end here.
        bits = (self.keys >> np.uint64(64 - FIRST_BITS)).astype(np.int64)
        self.present = np.zeros(1 << FIRST_BITS, bool)
        self.present[bits] = True
        self.first = np.full(1 << FIRST_BITS, -1, np.int32)
        self.first[bits[::-1]] = np.arange(len(bits), dtype=np.int32)[::-1]
        self.deepest = int(np.bincount(bits).max())
        self.padded = np.append(self.keys, np.zeros(self.deepest, np.uint64))
        #: The scores by the pieces' texts.
        self.gains = {self.text[i]: float(self.score[i]) for i in plain}
        #: Whether no piece goes on past a space, so that words can be split apart.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in (self.text[i] for i in plain))
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if i in set(self.byte.tolist()) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]

    @staticmethod
    def key_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return (h + len(piece) * int(LENGTH)) * int(SPREAD) & (2**64 - 1)

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these hashes are pieces', ascending, and those pieces."""
        bits = keys >> np.uint64(64 - FIRST_BITS)
        maybe = np.flatnonzero(self.present[bits])
        at, own = self.first[bits[maybe]], keys[maybe]
        right = self.padded[at] == own
        for step in range(1, self.deepest):
            also = self.padded[at + step] == own
            at[also] += step
            right |= also
        return maybe[right], self.ids[at[right]]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The pieces with these hashes; -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        where, found = self.hits(keys)
        out[where] = found
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Batch:
    """Words of one length with the hashes of their prefixes."""

    def __init__(self, words: list[str], vocabulary: Pieces) -> None:
        self.n, self.length, self.vocabulary = len(words), len(words[0]), vocabulary
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(self.n, self.length)
        #: By position, then word: what a step reads lies together.
        self.codes = np.ascontiguousarray(codes.T)
        one = np.ones(1, np.uint64)
        self.power = np.cumprod(np.concatenate([one, np.full(self.length, BASE, np.uint64)]))
        down = np.cumprod(np.full(self.length, np.uint64(pow(int(BASE), -1, 2**64)), np.uint64))
        self.prefix = np.zeros((self.length + 1, self.n), np.uint64)
        np.cumsum((self.codes + np.uint64(1)) * down[:, None], axis=0, out=self.prefix[1:])
        self.prefix *= self.power[:, None]

    def key(self, rows: np.ndarray | slice, start: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        size = end - start
        h = self.prefix[start, rows] * self.power[size]
        np.subtract(self.prefix[end, rows], h, out=h)
        h += np.uint64(size * int(LENGTH) % 2**64) if np.isscalar(size) else size.astype(np.uint64) * LENGTH
        h *= SPREAD
        return h

    def spans(self, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each start of a substring up to ``end``, the nearest first: the start, the words in which the substring is a piece, and the pieces."""
        for size in range(1, min(end, self.vocabulary.longest) + 1):
            yield end - size, *self.vocabulary.hits(self.key(slice(None), end - size, end))

    def edges(self, row: int, lo: int, hi: int, by_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of all substrings of one word that are pieces and end (or start) at the places from ``lo`` up
        to ``hi``, by that place, the shortest first; a character that is no piece has piece -1."""
        found = []
        for size in range(1, min(self.length, self.vocabulary.longest) + 1):
            ends = np.arange(max(lo, size) if by_end else lo + size, min(hi, self.length + 1 if by_end else self.length - size + 1) + (0 if by_end else size))
            if not len(ends):
                continue
            hit, ids = self.vocabulary.hits(self.key(row, ends - size, ends))
            if size == 1:
                every = np.full(len(ends), -1, np.int64)
                every[hit] = ids
                hit, ids = np.arange(len(ends)), every
            found.append((ends[hit] - size, ends[hit], ids))
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        order = np.argsort(end if by_end else start, kind="stable")
        return start[order], end[order], piece[order]

    def utf8(self, column: int, rows: np.ndarray) -> list[bytes]:
        return [chr(int(c)).encode("utf-8", "surrogatepass") for c in self.codes[column, rows]]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Batches of words of one length, with their places; words without characters are in none."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    lo = int(np.searchsorted(ordered, 1))
    while lo < len(order):
        size = int(ordered[lo])
        hi = min(int(np.searchsorted(ordered, size, "right")), lo + max(1, BATCH // size))
        places = order[lo:hi]
        yield places, [words[i] for i in places]
        lo = hi
