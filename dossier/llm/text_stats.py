"""Counts of each text that quality decisions rest on, over whole texts and without per-word Python."""

from __future__ import annotations

import numpy as np

from dossier.llm.words import SPACE, span_hashes, spans, whole_windows, window_hashes


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(characters)] = 1
    return out


SYMBOLS = _flags(b"#*$%&|<>")
SHOUTS = _flags(b"!?")
BARS = _flags(b"|")
UPPER = _flags(bytes(range(65, 91)))
LETTERS = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
#: A code point in a word: any byte but white space and UTF-8 continuation bytes.
WORD_POINT = np.ones(256, np.int64)
WORD_POINT[SPACE] = 0
WORD_POINT[0x80:0xC0] = 0
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[list(b".!?")] = True


def per_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring edges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[edges])


def _repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key occurs twice or more in its row; whether it is a later occurrence (in input order)."""
    if not len(row):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    same = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    later, multi = np.zeros(len(row), bool), np.zeros(len(row), bool)
    later[order[1:]] = same  # lexsort is stable: the first of a run is the earliest
    multi[order[1:]] |= same
    multi[order[:-1]] |= same
    return multi, later


def text_stats(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text; see the keys."""
    rows = len(offsets) - 1
    start, end, row = spans(raw, offsets)
    word_edges = np.searchsorted(start, offsets)
    out = {"n_words": np.diff(word_edges), "word_chars": per_row(WORD_POINT[raw], offsets)}
    for name, flags in (("n_symbols", SYMBOLS), ("n_shouts", SHOUTS), ("n_bars", BARS), ("n_upper", UPPER), ("n_letters", LETTERS)):
        out[name] = per_row(flags[raw], offsets)

    marks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(SYMBOLS[raw], out=marks[1:])
    out["n_marked_words"] = per_row(marks[end] > marks[start], word_edges)  # words with a symbol

    breaks = np.flatnonzero(raw == 10)
    line_start = np.union1d(offsets[:-1], breaks + 1)
    line_start = line_start[line_start < len(raw)]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(raw)), offsets[line_row + 1]) if len(line_start) else line_start
    line_end = line_end - ((line_end > line_start) & (raw[line_end - 1] == 10)) if len(line_start) else line_end
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_row = line_start[with_word], line_end[with_word], line_row[with_word]
    _, later = _repeated(line_row, span_hashes(raw, line_start, line_end, seed=5))
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows)
    if len(line_end):
        last = end[np.searchsorted(start, line_end) - 1] - 1
        out["n_ended_lines"] = np.bincount(line_row[SENTENCE_END[raw[last]]], minlength=rows)
    else:
        out["n_ended_lines"] = np.zeros(rows, np.int64)

    words = span_hashes(raw, start, end, seed=6)
    echo = np.zeros(len(words), np.int64)
    echo[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    out["n_echoes"] = per_row(echo, word_edges)  # words equal to the one before

    begins = whole_windows(row, 3)
    keys = window_hashes(words, 3, seed=6)[begins]
    multi, _ = _repeated(row[begins], keys)
    covered = np.zeros(len(row) + 3, np.int64)
    for shift in range(3):
        covered[begins[multi] + shift] = 1
    out["n_repeat_words"] = per_row(covered[: len(row)], word_edges)
    return out
