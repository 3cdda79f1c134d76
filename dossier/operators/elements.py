"""Chunks that follow a document's structure: headings, paragraphs, lists and tables.

Elements come in order of their place; a chunk holds neighbours under one
heading, up to a budget of tokens, and knows its heading path, its pages and its
elements. A longer element is cut into windows; a longer table into runs of rows,
each with the table's header. A document's elements stream past one open chunk,
so time is linear and memory that of a chunk, whatever the document's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENTS = "doc_id string, place int, kind string, level int, text string, page int"
CHUNKS = "doc_id string, chunk_index int, text string, headings array<string>, page_start int, page_end int, places array<int>, token_count int, chunk_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CHUNKS_A_BATCH = 500


class Counter(Protocol):
    def counts(self, texts: Sequence[str]) -> Sequence[int]: ...


class WordCounter:
    """One token a word."""

    def counts(self, texts: Sequence[str]) -> list[int]:
        return [len(WORD.findall(t)) for t in texts]


class SubwordCounter:
    """Tokens under a vocabulary file of the tokenizers library, without added special tokens."""

    def __init__(self, path: str):
        self.path = path

    def counts(self, texts: Sequence[str]) -> list[int]:
        return [len(e) for e in _vocabulary(self.path).encode_batch_fast(list(texts), add_special_tokens=False)]


@lru_cache(maxsize=2)
def _vocabulary(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Page(HTMLParser):
    """Elements of one page: (kind, level, text); rows of a table are lines, the header first."""

    BLOCKS = {"p", "div", "li", "td", "th", "tr", "table", "ul", "ol", "nav", "article", "section", "footer", "header", "title", "blockquote", "pre", *(f"h{i}" for i in range(1, 7))}

    def __init__(self):
        super().__init__()
        self.found, self.text, self.kind, self.level, self.hidden, self.rows, self.row = [], [], "paragraph", 0, 0, None, None

    def flush(self) -> str:
        text = " ".join(WORD.findall("".join(self.text)))
        self.text = []
        return text

    def close_block(self) -> None:
        text = self.flush()
        if self.row is not None:
            self.row.append(text)
        elif text:
            self.found.append((self.kind, self.level, text))

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        if tag not in self.BLOCKS:
            if tag == "br":
                self.text.append(" ")
            return
        if self.row is None or tag not in ("p", "div"):
            self.close_block() if self.row is None else self.flush()
        self.kind, self.level = ("heading", int(tag[1])) if re.fullmatch("h[1-6]", tag) else ("list", 0) if tag == "li" else ("paragraph", 0)
        if tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.row = []

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in ("td", "th") and self.row is not None:
            self.row.append(self.flush())
        elif tag == "tr" and self.row is not None:
            self.rows.append(" | ".join(c for c in self.row if c))
            self.row = None
        elif tag == "table" and self.rows is not None:
            lines = [r for r in self.rows if r]
            self.rows = self.row = None
            if lines:
                self.found.append(("table", 0, "\n".join(lines)))
        elif tag in self.BLOCKS and self.row is None:
            self.close_block()
            self.kind, self.level = "paragraph", 0

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.text.append(data)

    @classmethod
    def elements(cls, html: str) -> list[tuple[str, int, str]]:
        page = cls()
        page.feed(html)
        page.close()
        page.row = None
        page.close_block()
        return page.found


def page_elements(pages: DataFrame, doc_id: str, html: str) -> DataFrame:
    """(doc_id, place, kind, level, text, page) of web pages; scripts and styles left out, one page each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _Page.elements(text or "")
                kinds, levels, texts = ([f[i] for f in found] for i in range(3))
                columns = [[name] * len(found), range(1, len(found) + 1), kinds, levels, texts, [1] * len(found)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)], [c.split()[0] for c in ELEMENTS.split(", ")])

    return pages.select(F.col(doc_id).cast("string"), html).mapInArrow(run, ELEMENTS)


def pieces(kind: str, text: str, most: int, counter: Counter) -> Iterator[tuple[str, int]]:
    """(text, tokens) of an element within the budget: windows of words, or of table rows under the header; a single word or row beyond it stands alone."""
    whole = counter.counts([text])[0]
    if whole <= most:
        yield text, whole
        return
    head, units, glue = ("", WORD.findall(text), " ") if kind != "table" else (text.split("\n")[0], text.split("\n")[1:], "\n")
    sizes, n_head = counter.counts(units), counter.counts([head])[0] if head else 0
    part, n = [], 0
    for unit, size in zip(units, sizes, strict=True):
        if part and n_head + n + size > most:
            yield glue.join([head, *part] if head else part), n_head + n
            part, n = [], 0
        part.append(unit)
        n += size
    if part or head:
        yield glue.join([head, *part] if head else part), n_head + n


class _Open:
    """The chunk being filled, and the headings above it."""

    def __init__(self, doc: str):
        self.doc, self.path, self.index = doc, [], 0
        self.texts, self.n, self.pages, self.places = [], 0, [], []

    def heading(self, level: int, text: str) -> None:
        self.path = [(lv, t) for lv, t in self.path if lv < level] + [(level, text)]

    def put(self, text: str, size: int, page, place: int) -> None:
        self.texts.append(text)
        self.n += size
        self.places += [] if self.places[-1:] == [place] else [place]
        self.pages += [] if page is None else [page]

    def taken(self) -> tuple | None:
        """The finished chunk, if there is one; the next begins."""
        if not self.texts:
            return None
        text = "\n".join(self.texts)
        name = hashlib.sha256(f"{self.doc}\n{self.index}\n{self.places}\n{text}".encode()).hexdigest()[:12]
        out = (self.doc, self.index, text, [t for _, t in self.path], min(self.pages, default=None), max(self.pages, default=None), self.places, self.n, f"{self.doc}_chunk_{self.index:06d}_{name}")
        self.index += 1
        self.texts, self.n, self.pages, self.places = [], 0, [], []
        return out


def _fold(most: int, counter: Counter):
    kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.string())

    def shown(chunks: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c[i] for c in chunks], t) for i, t in enumerate(kinds)], [c.split()[0] for c in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for doc, place, kind, level, text, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or doc != now.doc:
                    out.append(now.taken() if now else None)
                    now = _Open(doc)
                if kind == "heading":
                    out.append(now.taken())
                    now.heading(level or 1, text or "")
                    continue
                for piece, size in pieces(kind, text or "", most, counter):
                    if now.texts and now.n + size > most:
                        out.append(now.taken())
                    now.put(piece, size, page, place)
                if len(out) >= CHUNKS_A_BATCH:
                    yield shown([c for c in out if c])
                    out = []
        out.append(now.taken() if now else None)
        yield shown([c for c in out if c])

    return run


def chunk_elements(elements: DataFrame, most: int = 512, counter: Counter | None = None) -> DataFrame:
    """CHUNKS of elements (doc_id, place, kind, level, text, page), neighbours under one heading packed in order.

    token_count is the sum over a chunk's pieces. Elements without words vanish;
    a heading without content gives no chunk of its own.
    """
    if most < 1:
        raise ValueError("a chunk needs a budget of one token at least")
    rows = elements.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("place").cast("int").alias("place"), "kind", F.col("level").cast("int").alias("level"), "text", F.col("page").cast("int").alias("page"))
    rows = rows.filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "place").mapInArrow(_fold(most, counter or WordCounter()), CHUNKS)
