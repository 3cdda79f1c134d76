"""Small column builders that every operator module uses."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_blank(x: ColumnOrName) -> Column:
    return F.coalesce(col(x), F.lit(""))


def strings(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def reasons(*conditions: tuple[Column, ColumnOrName]) -> Column:
    """Names of the conditions that hold, in the order given."""
    named = [F.when(c, F.lit(n) if isinstance(n, str) else n) for c, n in conditions]
    return F.array_compact(F.array(*named))


def ladder(*steps: tuple[Column, ColumnOrName], otherwise: ColumnOrName = "") -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in steps:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(condition, value) if out is None else out.when(condition, value)
    last = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    return last if out is None else out.otherwise(last)


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term is a substring."""
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def ranked(partition: Sequence[ColumnOrName], *order: Column) -> Column:
    """1, 2, ... within the partition; the last order column should be unique."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def ordered_values(value: ColumnOrName, *position: ColumnOrName) -> Column:
    """Aggregate: the group's values in order of position."""
    pairs = F.array_sort(F.collect_list(F.struct(*[col(p).alias(f"p{i}") for i, p in enumerate(position)], col(value).alias("v"))))
    return F.transform(pairs, lambda s: s["v"])


def ordered_distinct(value: ColumnOrName, *position: ColumnOrName) -> Column:
    """Aggregate: the group's non-blank distinct values, by first position."""
    return F.array_distinct(F.filter(ordered_values(value, *position), lambda v: v.isNotNull() & (v != "")))


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of each value that differs by more than case; blanks dropped."""
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    lowered = F.transform(kept, lambda v: F.lower(v))
    return F.filter(kept, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)
