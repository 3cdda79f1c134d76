"""Validation-time formulas and submission windows.

A formula bounds FA and FC by an anchor plus offsets, e.g.
`start+4W<=FA<=start+6W`; D, W, M and Y count 1, 7, 30 and 365 days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, col, text_or_blank

#: Days of each unit, default windows and gaps (fixed values).
UNIT_DAYS = {"D": 1, "W": 7, "M": 30, "Y": 365}
FC_AFTER_FA = 60
FC_WINDOW = 30
FA_FC_GAP = 21
PRIORITY_CONFIDENCE = {1: 0.9, 2: 0.6, 3: 0.3}
OTHER_CONFIDENCE = 0.2
TEMPLATE_START = dt.date(2007, 3, 1)
FINISH_WORDS = ("transportation", "delivery", "fob", "manufacturing", "fo b")
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d-MMM-yy", "d-MMM-yyyy")
RANGE = ("fa_earliest", "fa_recommended", "fa_latest", "fc_earliest", "fc_recommended", "fc_latest")

_TERM = "[+-][0-9]+(?:\\.[0-9]+)?[DWMYdwmy]m?"
_BOUND = f"((?:{_TERM})+)"
_ANCHOR = "(start|finish)"
#: (name, pattern) in the order tried; the groups are anchor, low terms, second anchor, high terms.
SHAPES = (
    ("joint", f"(?i)^{_ANCHOR}{_BOUND}<=FA<=FC<={_ANCHOR}{_BOUND}$"),
    ("fc", f"(?i)^{_ANCHOR}{_BOUND}<=FC<={_ANCHOR}{_BOUND}$"),
    ("fa", f"(?i)^{_ANCHOR}{_BOUND}<=FA<=?{_ANCHOR}{_BOUND}$"),
    ("fa_open", f"(?i)^{_ANCHOR}()<=FA<={_ANCHOR}{_BOUND}$"),
)


def offset_days(terms: ColumnOrName) -> Column:
    """Sum of signed terms; each is rounded half to even before it is added."""

    def days(term: Column) -> Column:
        unit = F.upper(F.regexp_extract(term, "([DWMYdwmy])m?$", 1))
        factor = F.create_map(*[F.lit(x) for pair in UNIT_DAYS.items() for x in pair])[unit]
        return F.bround(F.regexp_extract(term, "[0-9]+(?:\\.[0-9]+)?", 0).cast("double") * factor, 0).cast("int") * F.when(F.startswith(term, F.lit("-")), -1).otherwise(1)

    return F.aggregate(F.regexp_extract_all(col(terms), F.lit(_TERM), F.lit(0)), F.lit(0), lambda total, term: total + days(term))


def parse_validation_time(formula: ColumnOrName) -> Column:
    """Struct (valid, anchor, fa_lo, fa_hi, fc_lo, fc_hi); an unparsed multi-line formula counts by its first line."""

    def one(raw: Column) -> Column:
        packed = F.replace(F.regexp_replace(raw, "\\s+", ""), F.lit("=<"), F.lit("<="))
        out = None
        for name, pattern in SHAPES:
            low, high = (offset_days(F.regexp_extract(packed, pattern, g)) for g in (2, 4))
            fa, fc = name != "fc", name in ("joint", "fc")
            none = F.lit(None).cast("int")
            found = F.struct(
                F.lit(True).alias("valid"), F.lower(F.regexp_extract(packed, pattern, 1)).alias("anchor"),
                (low if fa else none).alias("fa_lo"), (high if fa else none).alias("fa_hi"), (low if fc else none).alias("fc_lo"), (high if fc else none).alias("fc_hi"),
            )
            out = F.when(packed.rlike(pattern), found) if out is None else out.when(packed.rlike(pattern), found)
        return out

    nothing = F.struct(F.lit(False).alias("valid"), F.lit("start").alias("anchor"), *[F.lit(None).cast("int").alias(n) for n in ("fa_lo", "fa_hi", "fc_lo", "fc_hi")])
    raw = F.trim(text_or_blank(formula))
    return F.coalesce(one(raw), F.when(raw.contains("\n"), one(F.trim(F.substring_index(raw, "\n", 1)))), nothing)


def describe_validation_time(parsed: Column, raw: ColumnOrName) -> Column:
    """Windows in words, e.g. `FA ∈ [start+28d, start+42d]`."""

    def part(name: str, lo: str, hi: str) -> Column:
        bound = lambda x: F.concat(parsed["anchor"], F.format_string("%+dd", parsed[x]))
        return F.when(parsed[lo].isNotNull(), F.concat(F.lit(f"{name} ∈ ["), bound(lo), F.lit(", "), bound(hi), F.lit("]")))

    both = F.concat_ws("  |  ", part("FA", "fa_lo", "fa_hi"), part("FC", "fc_lo", "fc_hi"))
    return F.when(parsed["valid"], both).otherwise(F.concat(F.lit("No rule ("), F.trim(text_or_blank(raw)), F.lit(")")))


def parse_date(x: ColumnOrName) -> Column:
    """A date in any of the known formats; a trailing `*` is dropped; null where none fits."""
    value = F.trim(F.replace(text_or_blank(x), F.lit("*"), F.lit("")))
    iso = F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?$"), F.substring(value, 1, 10).try_cast("date"))
    months = F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    pattern = "^([0-9]{1,2})-([A-Za-z]{3})-([0-9]{2}|[0-9]{4})$"
    year = F.regexp_extract(value, pattern, 3).try_cast("int")
    # two digits as in POSIX: 69-99 are the last century
    full = F.when(F.length(F.regexp_extract(value, pattern, 3)) == 4, year).otherwise(year + F.when(year >= 69, 1900).otherwise(2000))
    month = F.array_position(months, F.lower(F.regexp_extract(value, pattern, 2)))
    named = F.when(value.rlike(pattern) & (month > 0), F.format_string("%04d-%02d-%02d", full, month, F.regexp_extract(value, pattern, 1).try_cast("int")).try_cast("date"))
    return F.coalesce(iso, named)


def start_shift(project_start: ColumnOrName) -> Column:
    """Days from the template's start to the project's; 0 where none is given."""
    return F.coalesce(F.datediff(col(project_start).cast("date"), F.lit(TEMPLATE_START)), F.lit(0))


def anchor_date(start: ColumnOrName, finish: ColumnOrName, keywords: Column, shift: ColumnOrName | None = None) -> Column:
    """Finish for delivery-like keywords, else start; the other where the preferred one is missing; then shifted."""
    by_finish = F.exists(keywords, lambda k: F.lower(k).isin(*FINISH_WORDS))
    chosen = F.when(by_finish, F.coalesce(col(finish), col(start))).otherwise(F.coalesce(col(start), col(finish)))
    return chosen if shift is None else F.date_add(chosen, col(shift).cast("int"))


def midpoint(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.date_add(col(a), F.floor(F.datediff(col(b), col(a)) / 2).cast("int"))


def with_date_range(df: DataFrame, parsed: str, anchor: str, sub_type: str, floor: ColumnOrName | None = None) -> DataFrame:
    """Add the six dates of RANGE, floored_fields, start_anchored and range_note.

    FC follows FA by FC_AFTER_FA days where a formula names FA only; FA precedes
    FC likewise for FA submissions with an FC-only formula. FC starts at least
    FA_FC_GAP days after the recommended FA. Dates before `floor` are handled as
    in `floored`.
    """
    v, base = F.col(parsed), F.col(anchor)
    on = v["valid"] & base.isNotNull() & (F.col(sub_type) != "SKIP")
    at = lambda name: F.when(on, F.date_add(base, v[name]))
    df = df.withColumns({"fa_earliest": at("fa_lo"), "fa_latest": at("fa_hi"), "fc_earliest": at("fc_lo"), "fc_latest": at("fc_hi")})
    df = df.withColumns({"fa_recommended": midpoint("fa_earliest", "fa_latest"), "fc_recommended": midpoint("fc_earliest", "fc_latest")})
    half = FC_WINDOW // 2
    centre = F.date_add("fa_recommended", FC_AFTER_FA)
    no_fc = F.col("fc_recommended").isNull() & F.col("fa_recommended").isNotNull()
    derived = F.col("fc_recommended").isNotNull() & F.col("fa_recommended").isNull() & (F.col(sub_type) == "FA")
    back = F.date_sub("fc_recommended", FC_AFTER_FA)
    df = df.withColumn("range_note", _note(v, base, sub_type, derived))
    df = df.withColumns({
        "fc_earliest": F.when(no_fc, F.date_sub(centre, half)).otherwise(F.col("fc_earliest")),
        "fc_latest": F.when(no_fc, F.date_add(centre, half)).otherwise(F.col("fc_latest")),
        "fc_recommended": F.when(no_fc, centre).otherwise(F.col("fc_recommended")),
        "fa_earliest": F.when(derived, F.date_sub(back, half)).otherwise(F.col("fa_earliest")),
        "fa_latest": F.when(derived, F.date_add(back, half)).otherwise(F.col("fa_latest")),
        "fa_recommended": F.when(derived, back).otherwise(F.col("fa_recommended")),
    })
    short = F.greatest(F.lit(0), F.datediff(F.date_add("fa_recommended", FA_FC_GAP), F.col("fc_earliest")))
    short = F.coalesce(short, F.lit(0))
    df = df.withColumn("_gap", short).withColumns({c: F.date_add(c, F.col("_gap")) for c in ("fc_earliest", "fc_recommended", "fc_latest")}).drop("_gap")
    return floored(df, F.lit(None).cast("date") if floor is None else col(floor))


def _note(v: Column, base: Column, sub_type: str, derived: Column) -> Column:
    out = F.when(F.col(sub_type) == "SKIP", "excluded").when(~v["valid"], "no valid formula").when(base.isNull(), "missing anchor")
    return out.when(derived, "FA derived from FC").otherwise("")


def floored(df: DataFrame, floor: Column) -> DataFrame:
    """Keep dates from falling before the floor.

    Where the recommended date itself is earlier, all six move by one shift that
    puts the earliest on the floor (start_anchored); else each early date is
    clamped. floored_fields names the dates that were early, in order of RANGE.
    """
    early = [F.col(c) < floor for c in RANGE]
    any_early = F.coalesce(F.least(*RANGE) < floor, F.lit(False))
    primary = F.coalesce("fa_recommended", "fc_recommended")
    move = F.coalesce(primary < floor, F.lit(False))
    df = df.withColumns({
        "floored_fields": F.array_compact(F.array(*[F.when(e, F.lit(c)) for e, c in zip(early, RANGE, strict=True)])),
        "start_anchored": any_early & move,
        "_shift": F.when(any_early & move, F.datediff(floor, F.least(*RANGE))).otherwise(F.lit(0)),
    })
    return df.withColumns({c: F.when(F.col("start_anchored"), F.date_add(c, F.col("_shift"))).when(F.col(c) < floor, floor).otherwise(F.col(c)) for c in RANGE}).drop("_shift")


def floor_collapsed() -> Column:
    """Whether clamping, not the template, made the recommended date: it was clamped, or its window is one day."""

    def judged(kind: str) -> Column:
        return F.array_contains("floored_fields", f"{kind}_recommended") | F.coalesce(F.col(f"{kind}_earliest") == F.col(f"{kind}_latest"), F.lit(False))

    out = F.when(F.col("fa_recommended").isNotNull(), judged("fa")).when(F.col("fc_recommended").isNotNull(), judged("fc")).otherwise(F.lit(False))
    return ~F.col("start_anchored") & out


def range_confidence(priority: ColumnOrName) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PRIORITY_CONFIDENCE.items() for x in pair])
    return F.coalesce(table[col(priority)], F.lit(OTHER_CONFIDENCE))


def date_status(anchor: ColumnOrName) -> Column:
    """Which date is missing, else `generated`."""
    out = F.when(col(anchor).isNull(), "missing_date").when(F.col("fa_recommended").isNull() & F.col("fc_recommended").isNull(), "missing_date_range")
    return out.when(F.col("fa_recommended").isNull(), "missing_fa").when(F.col("fc_recommended").isNull(), "missing_fc").otherwise("generated")
