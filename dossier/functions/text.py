"""Scalar text functions: spaces, tokens, keys, tolerant parsing, display forms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, col, text_or_blank

#: Spellings of a missing value in registers (fixed values).
BLANK_WORDS = ("", "nan", "none", "null")


def blank_to_null(x: ColumnOrName) -> Column:
    value = F.trim(col(x))
    return F.when(~F.lower(value).isin(*BLANK_WORDS), value)


def normalize_space(x: ColumnOrName) -> Column:
    """`>`, `_` and control white space to spaces, runs collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(text_or_blank(x), ">_\t\r\n", "     "), " +", " "))


def collapse(x: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(text_or_blank(x), "\\s+", " "))


def word_tokens(x: ColumnOrName) -> Column:
    """`[a-z0-9]+` of the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(text_or_blank(x)), F.lit("[a-z0-9]+"), F.lit(0))


def rule_tokens(x: ColumnOrName) -> Column:
    """Distinct `[a-z0-9&]+` of two characters or more."""
    found = F.regexp_extract_all(F.lower(text_or_blank(x)), F.lit("[a-z0-9&]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))


def review_tokens(x: ColumnOrName, stop: tuple[str, ...] = ()) -> Column:
    """Distinct `[A-Z0-9]+` of two characters or more, without stop words."""
    found = F.regexp_extract_all(F.upper(text_or_blank(x)), F.lit("[A-Z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*stop) if stop else F.length(t) > 1))


def token_recall(wanted: Column, have: Column, floor: int = 3) -> Column:
    """Share of wanted tokens found; short lists count as `floor` tokens long."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, have)) / F.greatest(F.size(wanted), F.lit(floor))).otherwise(0.0)


def expand_query_tokens(tokens: Column, names: Mapping[str, str]) -> Column:
    """Add the abbreviation of each full name whose words are all present; names maps words to abbreviation."""
    added = [F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in words.split()]), tokens)) == 0, F.lit(short)) for words, short in names.items()]
    return F.array_distinct(F.concat(tokens, F.array_compact(F.array(*added))))


def key_text(x: ColumnOrName) -> Column:
    """Upper case, `&` spelled out, other characters to single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.upper(text_or_blank(x)), F.lit("&"), F.lit(" AND")), "[^A-Z0-9]+", " "))


def slug(x: ColumnOrName) -> Column:
    return F.replace(F.lower(key_text(x)), F.lit(" "), F.lit("_"))


def title_key(x: ColumnOrName) -> Column:
    return F.lower(collapse(x))


def short_sha1(x: ColumnOrName, n: int = 12) -> Column:
    return F.substring(F.sha1(col(x)), 1, n)


def short_sha256(x: ColumnOrName, n: int = 16) -> Column:
    return F.substring(F.sha2(col(x), 256), 1, n)


def title_id(x: ColumnOrName) -> Column:
    return F.concat(F.lit("title_"), short_sha1(title_key(x)))


def is_yes(x: ColumnOrName, default: bool = True) -> Column:
    """False for false, no, n and 0 in any case; null and blank take the default."""
    value = F.lower(F.trim(col(x)))
    return F.when(value.isNull() | (value == ""), F.lit(default)).otherwise(~value.isin("false", "no", "n", "0"))


def number_or_null(x: ColumnOrName) -> Column:
    return F.trim(col(x)).try_cast("double")


def bounded_int(x: ColumnOrName, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.trim(col(x)).try_cast("double").cast("int"), F.lit(low))))


def fixed(x: ColumnOrName, digits: int = 4) -> Column:
    """Fixed decimals; zero and null print nothing."""
    return F.when(col(x).isNull() | (col(x) == 0), F.lit("")).otherwise(F.format_string(f"%.{digits}f", col(x).cast("double")))


def split_list(x: ColumnOrName, separators: str = "[;\\n,]") -> Column:
    """Trimmed non-blank items of a delimited string."""
    return F.filter(F.transform(F.split(text_or_blank(x), separators), lambda v: F.trim(v)), lambda v: v != "")


def without_fence(x: ColumnOrName) -> Column:
    """Model output without a Markdown code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text_or_blank(x)), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", ""))


def chunk_ids(x: ColumnOrName) -> Column:
    return F.regexp_extract_all(text_or_blank(x), F.lit("[A-Za-z0-9_.&-]+_chunk_[0-9]+"), F.lit(0))


def longest_variant(x: ColumnOrName) -> Column:
    """Of `a | b | c`, the variant with most words, then most characters, then the earliest."""
    parts = split_list(x, "\\|")
    score = F.transform(parts, lambda v, i: F.struct(F.size(F.split(v, "\\s+")).alias("w"), F.length(v).alias("n"), (-i).alias("p"), v.alias("v")))
    return F.when(text_or_blank(x).contains(" | "), F.coalesce(F.array_max(score)["v"], F.lit(""))).otherwise(collapse(x))


def labelled_text(pairs: list[tuple[str, ColumnOrName]], separator: str = " | ") -> Column:
    """`Label: value` of each non-blank value."""
    return F.concat_ws(separator, *[F.when(text_or_blank(v) != "", F.concat(F.lit(f"{label}: "), col(v))) for label, v in pairs])


def phrase_query(terms: Column) -> Column:
    """Full-text query: distinct terms as quoted phrases joined by OR."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('\\"')), F.lit('"'))), " OR ")


def sections_text(pairs: list[tuple[str, ColumnOrName]]) -> Column:
    """Headed sections for a pair scorer, blank ones left out."""
    return F.concat_ws("\n\n", *[F.when(text_or_blank(v) != "", F.concat(F.lit(f"{label}:\n"), col(v))) for label, v in pairs])


def expand_abbreviations(x: ColumnOrName, rules: list[tuple[str, str]]) -> Column:
    """Whole-token replacements, longest abbreviation first, one after the other so that results can chain.

    A token boundary is any character outside A-Z and 0-9; case is ignored.
    """
    out = text_or_blank(x)
    for short, full in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        out = F.regexp_replace(out, f"(?i)(?<![A-Z0-9])\\Q{short}\\E(?![A-Z0-9])", full.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def with_expansions(values: Column, rules: list[tuple[str, str]]) -> Column:
    """The values, then their distinct expansions."""
    from dossier.functions.columns import distinct_ignoring_case

    return distinct_ignoring_case(F.concat(values, F.transform(values, lambda v: expand_abbreviations(v, rules))))


def last_levels(path: ColumnOrName, generic: tuple[str, ...], n: int = 3, separator: str = ">") -> Column:
    """The last n levels of a path that are not generic."""
    levels = F.filter(split_list(path, separator), lambda v: ~F.upper(v).isin(*generic) if generic else F.lit(True))
    return F.array_join(F.slice(levels, F.greatest(F.size(levels) - n + 1, F.lit(1)), n), " ")


def keep_known(pairs: Column) -> Column:
    """Map entries with a non-blank value."""
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))
