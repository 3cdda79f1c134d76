"""SentencePiece BPE encoding by backtracking, and decoding.

The merge order of a BPE model is only asked about pairs of tokens: a sequence
of tokens is the encoding exactly when each adjacent pair, merged again from
characters, falls back into the same two tokens. Encoding walks left to right
with the longest match of an Aho-Corasick automaton, tries shorter prefixes
where the pair is not compatible, steps back where none is left, and marks that
position in a bitfield so that it is never tried again. The number of steps is
linear in the text.

Defined results: null and empty texts are begin and end ids only. Characters
outside the vocabulary become byte pieces. Texts of any length are encoded whole.
Repeated rows and rows without doc_id give one row each. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.frames import documents
from dossier.llm.pieces import ChunkEncoder, chunk_spans, cut_points, distinct_chunks, flattened, gather
from dossier.llm.token_counts import tokenizer_path
from dossier.llm.words import slices, texts_of

MARK = "▁"
PAIR_MEMO = 2_000_000
SLICE = 8 << 20


class PieceCoder:
    """Encoder and decoder of one BPE model; its pieces are read through the library, its merges are not."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.ids, self.rank, self.byte_ids, self.text = {}, {}, {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value], self.text[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.rank[piece], self.text[i] = i, -model.get_score(i), piece.replace(MARK, " ").encode()
        #: bytes of all ids in one array, and where each id's begin
        texts = [self.text.get(i, b"") for i in range(model.get_piece_size())]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.byte_edges = np.append(0, np.cumsum([len(t) for t in texts]))
        self.matcher = ahocorasick.Automaton()
        for piece in self.ids:
            self.matcher.add_word(piece, piece)
        self.matcher.make_automaton()
        #: white space that a piece has after another character (here a carriage return) doesn't begin a chunk
        self.cuts = cut_points(piece.replace(MARK, " ") for piece in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str | None] = {}

    def merged(self, text: str) -> list[str]:
        """The defining procedure: merge the best-ranked adjacent pair, leftmost first, until none is left."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.merged(left + right) == [left, right]
            if len(self.pairs) < PAIR_MEMO:
                self.pairs[key] = known
        return known

    def prefix(self, piece: str) -> str | None:
        """The longest shorter piece that `piece` starts with."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), None)
        return self.shorter[piece]

    def longest(self, text: str) -> list[str | None]:
        """The longest piece that starts at each character."""
        out: list[str | None] = [None] * len(text)
        for last, piece in self.matcher.iter(text):
            at = last - len(piece) + 1
            if out[at] is None or len(out[at]) < len(piece):
                out[at] = piece
        return out

    def pieces(self, text: str) -> list[str]:
        """Pieces of a marked text; characters outside the vocabulary stand alone and part the text."""
        longest, out, pos, floor = self.longest(text), [], 0, 0
        failed = bytearray(len(text) + 1)
        while pos < len(text):
            piece = longest[pos]
            if piece is None:
                out.append(text[pos])
                pos += 1
                floor = len(out)
                continue
            while True:
                last = out[-1] if len(out) > floor else None
                if not failed[pos + len(piece)] and (last is None or self.compatible(last, piece)):
                    out.append(piece)
                    pos += len(piece)
                    break
                piece = self.prefix(piece)
                if piece is None:
                    if last is None:
                        raise ValueError(f"no encoding at character {pos}")
                    failed[pos] = 1
                    piece = out.pop()
                    pos -= len(piece)
        return out

    def encode_marked(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(text):
            known = self.ids.get(piece)
            ids.extend([known] if known is not None else [self.byte_ids[b] for b in piece.encode()])
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text with begin and end."""
        return [self.begin, *(self.encode_marked((" " + text).replace(" ", MARK)) if text else []), self.end]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(self.text.get(i, b"") for i in ids)
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> tuple[PieceCoder, ChunkEncoder]:
    own = PieceCoder(path)

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return flattened([own.encode_marked(c.decode().replace(" ", MARK)) for c in chunks])

    return own, ChunkEncoder(encode)


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk_ids = coder(path)
        for batch in batches:
            text = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            nothing = pa.scalar("", pa.large_string())
            text = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, nothing))
            raw_all, at_all = texts_of(text)
            counts, id_sums, text_sums = [], [], []
            for lo, hi in slices(at_all, SLICE):
                raw, offsets = raw_all[at_all[lo] : at_all[hi]], at_all[lo : hi + 1] - at_all[lo]
                start, end = chunk_spans(raw, offsets, own.cuts)
                codes, chunks = distinct_chunks(raw, start, end)
                flat, edges = chunk_ids(chunks)
                ids, id_ends = gather(flat, edges, codes)
                plain, plain_ends = gather(own.bytes, own.byte_edges, ids)
                plain_ends = np.append(0, plain_ends)[id_ends]  # by chunk
                first = np.searchsorted(start, offsets)
                id_at, plain_at = np.append(0, id_ends)[first], np.append(0, plain_ends)[first]
                blob, marked = raw.tobytes(), MARK.encode()
                for i in range(hi - lo):
                    own_text = blob[offsets[i] : offsets[i + 1]]
                    if marked in own_text:  # a literal mark could join the spaces after it
                        found = own.encode(own_text[1:].decode())
                        body, decoded = np.array(found[1:-1], np.uint32), own.decode(found).encode()
                    else:
                        body, decoded = ids[id_at[i] : id_at[i + 1]], plain[plain_at[i] : plain_at[i + 1]].tobytes()[1:]
                    counts.append(len(body) + 2)
                    id_sums.append(hashlib.sha256(np.concatenate([[own.begin], body, [own.end]]).astype("<u4").tobytes()).hexdigest())
                    text_sums.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; map side only."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode_batches(path), schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
