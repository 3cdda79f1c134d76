"""Secret scans: three fixed patterns, and a token-efficiency test for what they miss.

A byte-pair vocabulary learned on prose and code needs few tokens for what it
has seen and many for random strings. Runs of RUN_LENGTH characters or more that
mix letter cases or digits, and that no pattern has covered, are encoded with
such a vocabulary; fewer than RATIO characters a token expose a `random` span.
Digests (hexadecimal of a digest's length, or named as one in front) and
identifiers (UUIDs, words and numbers joined by signs or letter case) are left
out before. Texts that have no place for a span are told apart on whole batches
of bytes; only the others meet Python's patterns.

Defined results: a null or empty text has no spans, no counts and the digest of
an empty list. Every row is judged by itself, so repeated rows and rows without
doc_id give one row each. Spans of one start are ordered as KINDS lists them. A
span is that of the whole match, in code points. Texts of any length are read
whole. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.frames import documents
from dossier.llm.phrase_bitmaps import LOWER
from dossier.llm.token_counts import tokenizer_path
from dossier.llm.words import slices, texts_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGNED, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN_LENGTH = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RATIO = 2.2
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
DIGEST_NAME = re.compile(r"(?i:md5|sha-?(1|224|256|384|512)|blake2[bs]?|crc32|integrity|checksum|digest)\W{0,4}$")
DIGEST_HEAD = re.compile(r"(?i:md5|sha-?(1|224|256|384|512))[-_=/]")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: A word or number inside an identifier: `Name`, `NAME`, `name`, each with digits behind, or digits.
PART = re.compile(r"[A-Z]?[a-z]+\d*|[A-Z]+\d*(?![a-z])|\d+|[+/_=-]+")
#: Of an identifier's letters, this share stands in words of this length, spelt in this many characters a token or more.
WORD_SHARE, WORD_LENGTH, WORD_RATIO = 0.6, 3, 2.0
WORDS_BEFORE = (b"passw", b"secret", b"token", b"api_key", b"apikey")


def _flags(pattern: bytes) -> np.ndarray:
    return np.array([re.match(pattern, bytes([i])) is not None for i in range(256)])


IN_RUN, IN_HEX = _flags(b"[A-Za-z0-9+/_=-]"), _flags(b"[0-9a-f]")
CLASSES = [_flags(b"[a-z]"), _flags(b"[A-Z]"), _flags(b"[0-9]")]


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Callable[[str], int]:
    """Counts tokens under a vocabulary of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def is_digest(run: str, before: str) -> bool:
    if len(run) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    return bool(DIGEST_HEAD.match(run) or DIGEST_NAME.search(before))


def is_identifier(run: str, tokens: Callable[[str], int]) -> bool:
    """A UUID, or a run that falls into words and numbers, most of its letters in words that the vocabulary spells well."""
    if UUID.fullmatch(run):
        return True
    parts = [m.group() for m in PART.finditer(run)]
    if sum(map(len, parts)) != len(run):
        return False
    words = [w.lower() for p in parts if (w := p.rstrip("0123456789")).isalpha()]
    letters, long = sum(map(len, words)), sum(len(w) for w in words if len(w) >= WORD_LENGTH)
    return letters > 0 and long >= WORD_SHARE * letters and letters >= WORD_RATIO * tokens(" " + " ".join(words))


def mixed(run: str) -> bool:
    return sum(bool(re.search(c, run)) for c in ("[a-z]", "[A-Z]", "[0-9]")) >= 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, leftmost and non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGNED]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], tokens: Callable[[str], int]) -> list[tuple[int, int, int]]:
    """Runs that the vocabulary spells in few characters a token, none of which overlaps a span of the base."""
    out, at, reach = [], 0, 0
    for m in RUN.finditer(text):
        lo, hi = m.span()
        while at < len(base) and base[at][0] < hi:
            reach = max(reach, base[at][2])
            at += 1
        run = m.group()
        if reach > lo or not mixed(run) or is_digest(run, text[max(0, lo - 24) : lo]) or is_identifier(run, tokens):
            continue
        if len(run) < RATIO * tokens(run):
            out.append((lo, 3, hi))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in sorted(spans))


def _runs(flag: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of runs of flagged bytes of `least` or more; texts part them."""
    edges = offsets[:-1][np.diff(offsets) > 0]
    first = flag.copy()
    first[1:] &= ~flag[:-1]
    first[edges] = flag[edges]
    last = flag.copy()
    last[:-1] &= ~flag[1:]
    inner = edges[edges > 0] - 1
    last[inner] = flag[inner]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - start >= least
    return start[long], end[long]


def worth_reading(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the texts that can have a span."""
    if not len(raw):
        return np.zeros(0, np.int64)
    places = [_runs(IN_HEX[raw], offsets, HEX_LENGTH)[0]]
    start, end = _runs(IN_RUN[raw], offsets, RUN_LENGTH)
    if len(start):
        kinds = np.zeros(len(start), np.int64)
        for flags in CLASSES:
            total = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(flags[raw], out=total[1:])
            kinds += total[end] > total[start]
        places.append(start[kinds >= 2])
    for blob, words in ((raw.tobytes(), (b"AKIA",)), (LOWER[raw].tobytes(), WORDS_BEFORE)):
        for word in words:
            places.append(np.array([m.start() for m in re.finditer(word, blob)], np.int64))
    return np.unique(np.searchsorted(offsets, np.concatenate(places), "right") - 1)


def _scan_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            raw, at = texts_of(batch.column(1))
            n = len(batch)
            counts, digests, spans = np.zeros((len(KINDS), n), np.int64), [nothing] * n, [""] * n
            for lo, hi in slices(at):
                for i in worth_reading(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) + lo:
                    text = raw[at[i] : at[i + 1]].tobytes().decode()
                    base = base_spans(text)
                    found = base + random_spans(text, base, tokens_of(path))
                    for _, kind, _ in found:
                        counts[kind, i] += 1
                    digests[i], spans[i] = hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def secret_scan(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each row."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan_batches(vocabulary), f"doc_id long, {counts}, base_sha256 string, spans string")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"))
