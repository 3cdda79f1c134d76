"""Chunked counts, ids and pieces against the libraries on random awkward texts, in batches as Spark hands them over."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dossier.llm import packing, sentencepieces, token_counts
from dossier.llm.token_counts import load_tokenizer, tokenizer_path

ALPHABETS = [
    list("abc the in▁ \n=-#é日🙂"),
    ["\r\n", "\r", "\n", "\t", "\x0b", "\x0c", " ", "  ", ";", ")", ">", ",", ".", "end", "Line", "x", "\u0085", " ", " ", "　", "\x1c", "\x1f", "\x00", "\x01"],
    ["don", "'", "'s", "'LL", "É", "ß", "İ", "ſ", "é", "́", "×", "÷", "Ñ", "ü", "ÀÖØÞ", "12", "9", "²", "½", "a", "Z", "!", "…", "—", "_", "|", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "</w>", "endoftext", " ", "\n", "K", "ff"],
    ["int", " main", "(", ")", "{", "}", "\r\n", "    ", "\t", "//", "ABC", "日本語", "Привет", "мир", "ёж", "‍", "🙂", "👍🏽", " ", "%d", "\\n"],
]


def random_texts(n, seed):
    rng = random.Random(seed)
    out = [None, "", " ", "\r", "\r\n", "One sentence.\r\nNext line, here:\r\nend", "<p>hello</p>\r\n<b>x</b>", "x" * 5000, "é" * 3000, "ab " * 4000, "\r" * 300, "▁▁ a ▁b"]
    for sign in ";)>,.}]\"'x9é日▁":
        out += [f"a{sign}{space}b{space}{sign}" for space in " \t\n\x0b\x0c\r"]
    while len(out) < n:
        letters = rng.choice(ALPHABETS) if rng.random() < 0.7 else sum(ALPHABETS, [])
        out.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))))
    return out


@pytest.fixture(scope="module")
def batch():
    texts = random_texts(10_000, 11)
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def texts_of(batch):
    return [x or "" for x in batch.column(1).to_pylist()]


def test_counts(batch):
    path = tokenizer_path("byte_bpe_50k.json")
    (found,) = token_counts._count_batches(path)(iter([batch]))
    expected = [len(e.ids) for e in load_tokenizer(path).encode_batch(texts_of(batch), add_special_tokens=False)]
    assert found.column("n_tokens").to_pylist() == expected


def test_pieces(batch):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    (found,) = sentencepieces._encode_batches(path)(iter([batch]))
    for text, n, ids_sum, text_sum in zip(texts_of(batch), *(found.column(c).to_pylist() for c in ("n_tokens", "ids_sha256", "decoded_sha256")), strict=True):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert (n, ids_sum) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()), text
        assert text_sum == hashlib.sha256(library.decode(ids).encode()).hexdigest(), text


def test_no_cut_before_white_space_that_a_piece_holds():
    own = sentencepieces.PieceCoder(tokenizer_path("piece_bpe_32k.model"))
    joined = {c for piece in own.ids for a, c in zip(piece, piece[1:]) if a not in " ▁\t\n\x0b\x0c\r" and c in " ▁\t\n\x0b\x0c\r"}
    assert joined == {"\r"} and [b for b in (9, 10, 11, 12, 13, 32) if not own.cuts[b]] == [13]


@pytest.mark.parametrize("cap", [16, 2048])
def test_packed_pieces(batch, cap):
    path = tokenizer_path("word_bpe_49k.json")
    (found,) = packing._piece_batches(path, cap)(iter([batch]))
    expected = []
    for i, e in enumerate(load_tokenizer(path).encode_batch(texts_of(batch), add_special_tokens=False)):
        ids = np.array([*e.ids, packing.SEPARATOR], "<u4")
        expected += [(i, k, lo, len(ids[lo : lo + cap]), zlib.crc32(ids[lo : lo + cap].tobytes())) for k, lo in enumerate(range(0, len(ids), cap))]
    assert list(zip(*(found.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids_crc32")), strict=True)) == expected


def test_memo_gives_the_same_between_batches(batch):
    """A small memo fills; chunks beyond it are encoded again."""
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = packing.word_runs(path)
    tokenizer.encoder.__init__(tokenizer.encoder.encode, memo=50)
    halves = [batch.slice(0, 5000), batch.slice(5000)]
    found = pa.Table.from_batches(packing._piece_batches(path, 64)(iter(halves)))
    again = pa.Table.from_batches(packing._piece_batches(path, 64)(iter([batch])))
    assert found["ids_crc32"].to_pylist() == again["ids_crc32"].to_pylist()
    tokenizer.encoder.__init__(tokenizer.encoder.encode)
