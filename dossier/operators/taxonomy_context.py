"""The taxonomy value that a group's rows name: the longest alias in their text, row after row.

The text of a group is never put together. Rows are sorted over all tasks by
group and position; a task keeps, of what it has of a group, the best alias seen
and the first and last words, as many as an alias can reach across. These parts
join like the text would: an alias over the border of two parts lies in the last
words of one and the first words of the other. A large group is many parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import text_or_blank

PARTS = "_group string, _at long, best int, head array<string>, tail array<string>, n int"


def words_of(text: str) -> list[str]:
    return re.findall("[A-Z0-9]+", text.upper().replace("&", " AND "))


@dataclass
class Aliases:
    """Aliases as word sequences; the smaller number is the longer key, then the earlier in the list."""

    number: dict[tuple[str, ...], int]
    values: list[str]
    longest: int

    @classmethod
    def of(cls, aliases: Sequence[tuple[str, str]]) -> Aliases:
        known = [(tuple(words_of(alias)), value) for alias, value in aliases]
        order = sorted((k for k in known if k[0]), key=lambda k: -len(" ".join(k[0])))  # stable: the earlier of equal length
        number: dict[tuple[str, ...], int] = {}
        for i, (words, _) in enumerate(order):
            number.setdefault(words, i)
        return cls(number, [v for _, v in order], max((len(w) for w, _ in order), default=1))

    def best(self, words: Sequence[str]) -> int:
        """The number of the best alias among the words; as many as there are where none is."""
        found = len(self.values)
        for i in range(len(words)):
            for k in range(1, min(self.longest, len(words) - i) + 1):
                found = min(found, self.number.get(tuple(words[i : i + k]), found))
        return found


@dataclass
class Part:
    """What joins: the best alias, the first and last words (longest - 1 of them), and how many there are, up to that."""

    best: int
    head: list[str]
    tail: list[str]
    n: int

    @classmethod
    def of(cls, words: list[str], aliases: Aliases) -> Part:
        reach = aliases.longest - 1
        return cls(aliases.best(words), words[:reach], words[-reach:] if reach else [], min(len(words), reach))

    def joined(self, other: Part, aliases: Aliases) -> Part:
        reach = aliases.longest - 1
        border = aliases.best(self.tail + other.head)
        head = self.head if self.n >= reach else (self.head + other.head)[:reach]
        tail = other.tail if other.n >= reach else (self.tail + other.tail)[-reach:] if reach else []
        return Part(min(self.best, other.best, border), head, tail, min(reach, self.n + other.n))


def _parts(aliases: Aliases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, part = None, 0, None
        for batch in batches:
            out = []
            for g, p, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                new = Part.of(words_of(text), aliases)
                if part is not None and g == group:
                    part = part.joined(new, aliases)
                    continue
                if part is not None:
                    out.append((group, at, part))
                group, at, part = g, p, new
            yield _rows(out)
        if part is not None:
            yield _rows([(group, at, part)])

    return run


def _rows(parts: list) -> pa.RecordBatch:
    columns = [[g for g, _, _ in parts], [a for _, a, _ in parts], *[[getattr(p, c) for _, _, p in parts] for c in ("best", "head", "tail", "n")]]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_group", "_at", "best", "head", "tail", "n"])


def _joined(aliases: Aliases):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["_at"])
        part = None
        for r in rows:
            new = Part(r["best"], r["head"], r["tail"], r["n"])
            part = new if part is None else part.joined(new, aliases)
        value = aliases.values[part.best] if part.best < len(aliases.values) else None
        return pa.table({"_group": pa.array([rows[0]["_group"]]), "value": pa.array([value], pa.string())})

    return run


def forced_values(rows: DataFrame, by: Sequence[str], position: str, columns: Sequence[str], aliases: Sequence[tuple[str, str]], otherwise: str) -> DataFrame:
    """(by, value) of each group: the value of the longest alias in its rows' columns, as whole words, across rows too; else `otherwise`.

    position: unique in a group, of integers. Blank and null cells hold no words.
    """
    known = Aliases.of(aliases)
    text = F.concat_ws(" | ", *[text_or_blank(c) for c in columns])
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    keyed = rows.select(key.alias("_group"), F.col(position).cast("long").alias("_at"), text.alias("_text"))
    spread = keyed.repartitionByRange("_group", "_at").sortWithinPartitions("_group", "_at")
    parts = spread.mapInArrow(_parts(known), PARTS)
    # a group's parts are as many as tasks hold rows of it
    found = parts.groupBy("_group").applyInArrow(_joined(known), "_group string, value string")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    return found.select(F.from_json("_group", shape).alias("_k"), F.coalesce("value", F.lit(otherwise)).alias("value")).select("_k.*", "value")
