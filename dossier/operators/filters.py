"""Row filters and side outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, col, contains_any, text_or_blank
from dossier.functions.text import collapse, is_yes

LEAST_CHARS = 80
LEAST_LETTERS = 20
LEAST_SHARE = 0.25
# Chunk types and labels that carry no requirement.
NOISE_TYPES = ("separator", "toc")
NOISE_LABELS = ("document_index",)
# What marks a title as a date, an internal note or a placeholder.
NOT_TITLES = ("(?iU)\\bpo\\s*기준\\b", "(?iU)\\bpo\\s*base(?:d)?\\b", "(?U)\\b\\d{1,2}\\s*월\\s*\\d{1,2}\\s*일\\b", "(?U)\\b\\d{4}[-./]\\d{1,2}[-./]\\d{1,2}\\b", "(?U)제출\\s*날짜", "플기팀|구매팀")
PLACEHOLDERS = ("-", "--", "tbd", "n a", "na", "none", "null")
MISSING = ("nan", "none", "null", "n/a")
SHORT_NOTES = ("remark", "note", "date", "schedule 기준")


def text_noise(df: DataFrame, text: str) -> DataFrame:
    """Adds n_packed, n_letters and noise: null for usable text, else why not. Lengths leave white space out."""
    packed = F.regexp_replace(text_or_blank(text), "[\\x09-\\x0D\\x20]+", "")
    letters = F.length(F.regexp_replace(text_or_blank(text), "[^\\p{L}]", ""))
    df = df.withColumns({"n_packed": F.length(packed), "n_letters": letters})
    thin = (F.col("n_letters") < LEAST_LETTERS) | (F.col("n_letters") / F.col("n_packed") < LEAST_SHARE)
    return df.withColumn("noise", F.when(F.col("n_packed") < LEAST_CHARS, "short").when(thin, "not_text"))


def without_noise(chunks: DataFrame, text: str = "text", kind: str = "chunk_type", labels: str = "label") -> DataFrame:
    """Chunks that can hold a requirement."""
    marked = F.lower(text_or_blank(kind)).isin(*NOISE_TYPES) | F.coalesce(F.arrays_overlap(F.col(labels), F.array(*[F.lit(x) for x in NOISE_LABELS])), F.lit(False))
    return text_noise(chunks.filter(~marked), text).filter("noise is null").drop("noise", "n_packed", "n_letters")


def touches_pages(pages: ColumnOrName, first: int | None, last: int | None) -> Column:
    """Whether any page lies in the range; an open end has no bound."""
    low, high = F.lit(first if first is not None else 0), F.lit(last if last is not None else 2**31 - 1)
    return F.exists(col(pages), lambda p: (p >= low) & (p <= high))


def is_not_title(title: ColumnOrName) -> Column:
    """Blank, a placeholder, a date or internal note, or a remark of two words at most."""
    raw = collapse(title)
    value = F.when(F.lower(raw).isin(*MISSING), "").otherwise(raw)
    key = F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9가-힣]+", " "))
    out = (value == "") | key.isin(*PLACEHOLDERS)
    for pattern in NOT_TITLES:
        out = out | value.rlike(pattern)
    return out | ((F.size(F.split(value, " ")) <= 2) & contains_any(key, SHORT_NOTES))


def split_rows(df: DataFrame, rejected: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected); an unknown condition keeps the row."""
    bad = F.coalesce(rejected, F.lit(False))
    return df.filter(~bad), df.filter(bad)


def rejection(df: DataFrame, reason: ColumnOrName) -> DataFrame:
    """(reason, payload): the whole row as JSON."""
    return df.select((F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.to_json(F.struct("*")).alias("payload"))


def schedulable(df: DataFrame) -> DataFrame:
    """Selected rows that are accepted or need review; a column that is absent doesn't filter."""
    if "candidate_selection_status" in df.columns:
        df = df.filter(F.lower("candidate_selection_status") == "selected")
    if "candidate_status" in df.columns:
        df = df.filter(F.lower("candidate_status").isin("accepted", "needs_review"))
    return df


def retrieval_candidates(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(is_yes(flag)) if flag in df.columns else df


def allowed_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose normalised value is on the list; an empty list allows all."""
    return df.filter(F.lower(collapse(column)).isin(*[a.lower() for a in allowed])) if allowed else df
