"""Chunks and ids for a vocabulary that drops white space, folds case and parts words into runs of one kind.

Where a tokenizer file declares exactly that, a word of ASCII characters and
Latin-1 letters is cut into its runs (letters, single digits, other signs),
folded, and each distinct run goes to the file's merges alone. Words with an
apostrophe, any other character or the head of a special token go to the whole
tokenizer, as does everything where the file declares something else.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from dossier.llm.pieces import ChunkEncoder, flattened
from dossier.llm.token_counts import load_tokenizer
from dossier.llm.words import spans

#: What the file must declare for words to be cut into runs.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")
MARK = "\x01"
TOGETHER = 2000
LETTER, DIGIT, SIGN, WHOLE = 1, 2, 3, 4
KIND = np.full(256, WHOLE, np.int8)
KIND[0x21:0x7F] = SIGN
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[ord("'")] = WHOLE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: U+00C0 to U+00FF are letters but for two signs; the first 31 fold to the 32nd after them.
LATIN_LEAD = 0xC3
LATIN_SIGNS = (0x97, 0xB7)


class WordRuns:
    """Cuts texts into chunks and encodes them as one tokenizer file does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            declared = json.load(f)
        self.merges = None
        self.heads = sorted({t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        if self._parts_into_runs(declared):
            suffix = declared["model"]["end_of_word_suffix"]
            level = declared["pre_tokenizer"]["pretokenizers"][1]
            declared |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}, "post_processor": None, "added_tokens": []}
            self.merges = Tokenizer.from_str(json.dumps(declared))
            self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in declared["model"]["vocab"].items():
                self.ends_word[i] = token.endswith(suffix)
        del declared
        self.encoder = ChunkEncoder(self._encode)

    @staticmethod
    def _parts_into_runs(declared: dict) -> bool:
        normalizer, parts, model = declared.get("normalizer") or {}, declared.get("pre_tokenizer") or {}, declared["model"]
        if [x["type"] for x in normalizer.get("normalizers", [])] != NORMALIZERS or [x["type"] for x in parts.get("pretokenizers", [])] != ["Split", "ByteLevel"]:
            return False
        space, (split, level) = normalizer["normalizers"][1], parts["pretokenizers"]
        return (
            space["pattern"] == {"Regex": r"\s+"} and split["pattern"] == {"Regex": SPLIT} and split["behavior"] == "Removed" and split["invert"]
            and not level["add_prefix_space"] and not level["use_regex"] and model["type"] == "BPE" and bool(model["end_of_word_suffix"])
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        )

    def chunks(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start, end): the chunks of all words, with case folded where that changes no id."""
        start, end, _ = spans(raw, offsets)
        if self.merges is None or not len(start):
            return raw, start, end
        kind, folded = KIND[raw], LOWER[raw]
        after = np.flatnonzero(raw == LATIN_LEAD) + 1
        after = after[(raw[after] != LATIN_SIGNS[0]) & (raw[after] != LATIN_SIGNS[1])]
        kind[after] = kind[after - 1] = LETTER
        folded[after[raw[after] < 0x9F]] += 32
        for head in self.heads:
            at = np.flatnonzero(raw == head[0])
            if len(head) > 1:
                at = at[(at + 1 < len(raw))]
                at = at[raw[at + 1] == head[1]]
            kind[at] = WHOLE
        whole = np.unique(np.searchsorted(start, np.flatnonzero(kind == WHOLE), "right") - 1)
        change = np.zeros(len(raw) + 1, np.int8)
        change[start[whole]] += 1
        change[end[whole]] -= 1
        inside = (kind > 0) & (np.cumsum(change[:-1], dtype=np.int8) == 0)
        first = np.zeros(len(raw), bool)
        first[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        first[start] = True
        begin = np.flatnonzero(first)
        return np.where(inside, folded, raw), begin, np.minimum(np.append(begin[1:], len(raw)), end[np.searchsorted(start, begin, "right") - 1])

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words in one call, parted by a mark that none of them holds; one by one if the marks don't come back."""
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == mark[0])
        if len(mark) != 1 or len(cuts) != len(words) - 1 or any(MARK in w for w in words):
            return flattened([self.tokenizer.encode(w, add_special_tokens=False).ids for w in words])
        edges = np.concatenate([[0], cuts - np.arange(len(cuts)), [len(ids) - len(cuts)]])
        return np.delete(ids, cuts), edges

    def _plain(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.merges.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, np.uint32)
        edges = np.append(0, np.flatnonzero(self.ends_word[ids]) + 1)
        if len(edges) != len(runs) + 1 or edges[-1] != len(ids):
            raise RuntimeError("a run's last token doesn't end a word")
        return ids, edges

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        is_plain = np.array([self.merges is not None and PLAIN.fullmatch(c) is not None for c in chunks], bool)
        flats, sizes, order = [], [], []
        for which, encode in ((True, self._plain), (False, self._whole)):
            at = np.flatnonzero(is_plain == which)
            for lo in range(0, len(at), TOGETHER):
                part = at[lo : lo + TOGETHER]
                flat, edges = encode([chunks[i].decode() for i in part])
                flats.append(flat)
                sizes.append(np.diff(edges))
                order.append(part)
        flat, size, order = (np.concatenate(x) for x in (flats, sizes, order))
        # back into the order asked
        begin = np.cumsum(size) - size
        back = np.argsort(order, kind="stable")
        edges = np.append(0, np.cumsum(size[back]))
        at = np.repeat(begin[back] - edges[:-1], size[back]) + np.arange(edges[-1])
        return flat[at], edges


@lru_cache(maxsize=2)
def word_runs(path: str) -> WordRuns:
    return WordRuns(path)
