"""Phrases of one shard from compressed position bitmaps.

Positions number the words of a shard. A bitmap is a sorted list of containers
of 16 positions with their bits, kept only where a bit is set. The bitmap of a
phrase holds the places of its last word: extending it by a word shifts it by
one, cuts it with the places that begin no piece, and cuts it with the word's
own bitmap; the popcount is the phrase's count. Many phrases take a step
together, as (node, container, bits) triples; each container lists the words
that have bits in it, so a phrase meets only those. Phrases with the same first
words are followed to their full length before the next ones, which bounds what
is open at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from dossier.llm.key_filter import KeySet
from dossier.llm.words import U64, mix, span_hashes

WIDTH = 16
#: Triples that take a step together.
OPEN = 1 << 16


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: What ends a piece; with blank and tab, what ends a word.
BREAK = _table(b".,;:!?\n\x0b\x0c\r")
GAP = BREAK | _table(b" \t")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def piece_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, whether it begins a piece) of each word; raw is lower-cased already."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, bool)
    letter = ~GAP[raw]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    first[edges] = letter[edges]
    last[:-1] &= ~letter[1:]
    inner = edges[edges > 0] - 1
    last[inner] = letter[inner]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    breaks = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(BREAK[raw], out=breaks[1:])
    begins = np.ones(len(start), bool)
    if len(start):
        begins[1:] = (row[1:] != row[:-1]) | (breaks[start[1:]] != breaks[end[:-1]])
    return start, end, row, begins


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(raw, start, end, seed=12)


def first_key(words: np.ndarray, lang: int) -> np.ndarray:
    return mix(words ^ U64(lang))


def longer_key(prefix: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Key of a phrase from that of its beginning and its last word."""
    return mix(prefix * U64(0x9FB21C651E98DF25) + mix(words ^ U64(0x5BD1E9955BD1E995)))


@dataclass
class Level:
    """Phrases of one length that begin with the words at hand: key, last word and count of each node, and their bitmaps."""

    key: np.ndarray
    last: np.ndarray
    count: np.ndarray
    parent: np.ndarray
    node: np.ndarray
    container: np.ndarray
    bits: np.ndarray

    def only(self, keep: np.ndarray) -> Level:
        """The nodes that `keep` marks, numbered anew."""
        new = np.cumsum(keep) - 1
        held = keep[self.node]
        return Level(self.key[keep], self.last[keep], self.count[keep], self.parent[keep], new[self.node[held]], self.container[held], self.bits[held])


class Shard:
    """Bitmaps of the words that `frequent` lets through."""

    def __init__(self, words: np.ndarray, begins: np.ndarray, lang: int, frequent: KeySet | None):
        self.lang, self.size = lang, len(words)
        self.words, codes, n = np.unique(words, return_inverse=True, return_counts=True)
        self.key, self.n = first_key(self.words, lang), n
        use = frequent.has(self.key) if frequent else np.zeros(len(self.words), bool)
        at = np.flatnonzero(use[codes])
        code = codes[at]
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        containers = self.size // WIDTH + 2
        place = code.astype(np.int64) * containers + at // WIDTH
        edge = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        one = np.left_shift(1, at % WIDTH).astype(np.uint16)
        self.bits = np.add.reduceat(one, edge, dtype=np.uint16) if len(edge) else np.zeros(0, np.uint16)
        self.word, self.container = code[edge].astype(np.int32), (at[edge] // WIDTH).astype(np.int32)
        # the same bitmaps, listed by container
        by = np.argsort(self.container, kind="stable")
        self.there, self.there_bits = self.word[by], self.bits[by]
        self.edges = np.searchsorted(self.container[by], np.arange(containers + 1))
        going = np.flatnonzero(~begins)
        self.inside = np.bincount(going // WIDTH, np.left_shift(1, going % WIDTH), containers).astype(np.uint16)

    def beginnings(self) -> Iterator[Level]:
        """Single words, some OPEN triples at a time; a word is never parted."""
        lo = 0
        while lo < len(self.word):
            hi = min(lo + OPEN, len(self.word))
            hi = int(np.searchsorted(self.word, self.word[hi - 1], "right"))
            codes, node = np.unique(self.word[lo:hi], return_inverse=True)
            yield Level(self.key[codes], codes, self.n[codes], codes, node, self.container[lo:hi], self.bits[lo:hi])
            lo = hi

    def extended(self, level: Level) -> Level:
        """Every phrase of one word more that occurs here."""
        up = (level.bits << np.uint16(1)) & np.uint16(0xFFFF)
        over = np.flatnonzero(level.bits >> np.uint16(WIDTH - 1))
        node = np.concatenate([level.node, level.node[over]])
        container = np.concatenate([level.container, level.container[over] + 1])
        bits = np.concatenate([up, np.ones(len(over), np.uint16)]) & self.inside[container]
        live = np.flatnonzero(bits)
        node, container, bits = node[live], container[live], bits[live]
        parts = []
        for lo in range(0, len(node), OPEN):
            c = container[lo : lo + OPEN]
            n = self.edges[c + 1] - self.edges[c]
            ends = np.cumsum(n)
            mine = np.repeat(np.arange(len(c)), n)
            other = np.arange(int(ends[-1])) + np.repeat(self.edges[c] - (ends - n), n)
            both = bits[lo : lo + OPEN][mine] & self.there_bits[other]
            hit = np.flatnonzero(both)
            mine = mine[hit] + lo
            parts.append((node[mine], self.there[other[hit]], container[mine], both[hit]))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint16))
        node, word, container, bits = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
        pair, new = np.unique(node.astype(np.int64) * len(self.words) + word, return_inverse=True)
        parent, word = pair // max(1, len(self.words)), pair % max(1, len(self.words))
        count = np.bincount(new, np.bitwise_count(bits), len(pair)).astype(np.int64)
        return Level(longer_key(level.key[parent], self.words[word]), word, count, parent, new, container, bits)

    def pair_keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return longer_key(self.key[left], self.words[right])

    def follow(self, longest: int, wanted: Callable[[int, Level, Level], np.ndarray], seen: Callable[[int, Level], None]) -> None:
        """Depth first: `wanted` says which new phrases of a length stay (after their parents), `seen` gets those."""
        for level in self.beginnings():
            level = level.only(wanted(1, level, level))
            seen(1, level)
            for length in range(2, longest + 1):
                if not len(level.key):
                    break
                longer = self.extended(level)
                level = longer.only(wanted(length, longer, level))
                seen(length, level)
