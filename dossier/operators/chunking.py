"""Text chunks of a token budget, from paragraphs or HTML."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, text_or_blank

MOST_TOKENS = 512


def html_text(html: ColumnOrName) -> Column:
    """Visible text: scripts, styles, comments and tags dropped, block ends as line breaks, basic entities decoded."""
    x = F.regexp_replace(text_or_blank(html), "(?is)<(script|style)\\b[^>]*>.*?</\\1>|<!--.*?-->", " ")
    x = F.regexp_replace(x, "(?i)</(p|div|li|h[1-6]|tr|title|nav|ul|ol|table|section|article)>|<br ?/?>", "\n")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), " ?\\n[ \\n]*", "\n"))


def packed(pieces: Iterable[tuple[str, int, bool]], most: int) -> Iterator[tuple[list[str], int, bool]]:
    """(texts, tokens, whether it starts inside a paragraph) of each chunk, in one pass: a piece joins the open chunk where it fits."""
    texts, n, inside = [], 0, False
    for text, size, more in pieces:
        if texts and (more or n + size > most):
            yield texts, n, inside
            texts, n = [], 0
        if not texts:
            inside = more
        texts.append(text)
        n += size
    if texts:
        yield texts, n, inside


def paragraph_pieces(text: str, most: int) -> Iterator[tuple[str, int, bool]]:
    """(text, words, whether it goes on a paragraph): paragraphs, and windows of `most` words of longer ones."""
    for line in text.split("\n"):
        line = line.strip(" ")
        if not line:
            continue
        words = re.split("[ \t\x0b\f\r]+", line)
        if len(words) <= most:
            yield line, len(words), False
        else:
            for i in range(0, len(words), most):
                part = words[i : i + most]
                yield " ".join(part), len(part), i > 0


def packed_paragraphs(docs: DataFrame, doc_id: str, text: str, most: int = MOST_TOKENS) -> DataFrame:
    """(doc_id, chunk_index, text, token_count, chunk_id, continues): paragraphs packed in order, no chunk over `most` words.

    A paragraph longer than the budget is cut into windows of `most` words, joined
    by single spaces; the last one takes what follows. continues marks chunks that
    start inside a paragraph. chunk_id holds the document, the index and 12 digits
    of the text's SHA-256. A text is read once, whatever its length.
    """
    if most < 1:
        raise ValueError("a chunk needs a budget of one word at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                for i, (texts, n, inside) in enumerate(packed(paragraph_pieces(value or "", most), most)):
                    at.append(row)
                    found.append((i, "\n".join(texts), n, inside))
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["doc_id", "chunk_index", "text", "token_count", "continues"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_blank(text).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, chunk_index int, text string, token_count int, continues boolean")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.format_string("%06d", "chunk_index"), F.lit("_"), F.substring(F.sha2("text", 256), 1, 12))
    return out.select("doc_id", "chunk_index", "text", "token_count", name.alias("chunk_id"), "continues")


def chunk_paragraphs(docs: DataFrame, doc_id: str, text: str, most: int = MOST_TOKENS) -> DataFrame:
    """(doc_id, chunk_index, text, token_count, chunk_id) of the packed paragraphs."""
    return packed_paragraphs(docs, doc_id, text, most).drop("continues")
