"""Register dedup, consolidation, renumbering, validation and list building."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, ladder, ordered_values, ranked, reasons
from dossier.functions.text import collapse, title_id, title_key

REQUIRED_BLOCK = 10_000
MERGED = {"project_names": " | ", "source_file": " | ", "document_no": " | ", "equipment": " ; ", "building": " ; ", "system": " ; ", "study_survey": " ; ", "others": " ; ", "deliverable": " ; "}


def merge_titles(rows: DataFrame, title: str, position: str, merged: dict[str, str]) -> DataFrame:
    """One row a normalised title: its earliest spelling, merged columns as ordered distinct values, first_position.

    `merged` maps a column to the separator its values are joined with. The
    doc_id comes from the title.
    """
    rows = rows.filter(collapse(title) != "").withColumn("title_key", title_key(title))
    out = rows.groupBy("title_key").agg(F.min_by(title, position).alias(title), F.min(position).alias("first_position"), F.count(F.lit(1)).alias("n_rows"))
    return with_group(out, joined_values(rows, ["title_key"], position, merged), ["title_key"]).withColumn("doc_id", title_id(title))


def title_state(rows: DataFrame, title: str, position: str, merged: Sequence[str]) -> DataFrame:
    """What merge_titles keeps of a title, in a form that further rows can be merged into.

    One row a normalised title: title_key, its earliest spelling, first_position,
    n_rows, and `cells`: each column's distinct values with their first position.
    Positions of all registers are of one order (a number of the register first).
    """
    rows = rows.filter(collapse(title) != "").withColumn("title_key", title_key(title))
    base = rows.groupBy("title_key").agg(F.min_by(title, position).alias("title"), F.min(position).alias("first_position"), F.count(F.lit(1)).alias("n_rows"))
    spread = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in merged])
    cells = rows.select("title_key", F.col(position).alias("at"), F.explode(spread).alias("c")).select("title_key", "c.*", "at").filter("value <> ''")
    return with_group(base, _first_cells(cells), ["title_key"])


def _first_cells(cells: DataFrame) -> DataFrame:
    """(title_key, cells) from (title_key, column, value, at): equal values meet before they are gathered."""
    firsts = cells.groupBy("title_key", "column", "value").agg(F.min("at").alias("at"))
    return firsts.groupBy("title_key").agg(F.array_sort(F.collect_list(F.struct("column", "at", "value"))).alias("cells"))


def merged_states(held: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """One state of the rows of both, without any of them: earliest spelling, summed counts, first positions."""
    if held is None:
        return incoming
    both = held.unionByName(incoming)
    base = both.groupBy("title_key").agg(F.min_by("title", "first_position").alias("title"), F.min("first_position").alias("first_position"), F.sum("n_rows").alias("n_rows"))
    return with_group(base, _first_cells(both.select("title_key", F.explode("cells").alias("c")).select("title_key", "c.*")), ["title_key"])


def titles_of(state: DataFrame, merged: Mapping[str, str]) -> DataFrame:
    """The rows that merge_titles gives: each column's values in order of first position, joined by its separator."""
    cells = F.coalesce("cells", F.array().cast("array<struct<column:string,at:bigint,value:string>>"))
    values = lambda c: F.array_join(F.transform(F.array_sort(F.transform(F.filter(cells, lambda x: x["column"] == c), lambda x: F.struct(x["at"].alias("at"), x["value"].alias("value")))), lambda x: x["value"]), merged[c])
    return state.select("title_key", "title", "first_position", "n_rows", *[values(c).alias(c) for c in merged], title_id("title").alias("doc_id"))


def joined_values(rows: DataFrame, keys: Sequence[str], position: str, joined: Mapping[str, str]) -> DataFrame:
    """keys and, for each column of `joined`, its non-blank distinct values by first position, joined by its separator.

    Equal values of a group meet in a minimum before anything is gathered, so a
    group holds its distinct values in memory and never its rows.
    """
    keys = list(keys)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in joined])
    spread = rows.select(*keys, F.col(position).alias("_at"), F.explode(cells).alias("_c")).select(*keys, "_at", "_c.*")
    firsts = spread.filter("value <> ''").groupBy(*keys, "column", "value").agg(F.min("_at").alias("_at"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("column") == c, F.struct("_at", "value")))), lambda x: x["value"])
    gathered = firsts.groupBy(*keys).agg(*[F.array_join(listed(c), sep).alias(c) for c, sep in joined.items()])
    return with_group(rows.select(*keys).distinct(), gathered, keys).fillna("", list(joined))


def with_group(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys, where null keys meet null keys."""
    named = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in found.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def upsert_candidates(rows: DataFrame, identity: Sequence[Column], score: str, position: str, source: str, payload: Sequence[str]) -> DataFrame:
    """One row an identity: the best-scored payload (earliest on ties) and all sources in order.

    identity lists keys from strongest to weakest; the first that is not null names the row.
    """
    keyed = rows.withColumn("candidate_key", F.coalesce(*identity))
    best = [F.max_by(c, F.struct(F.col(score), -F.col(position))).alias(c) for c in payload]
    return keyed.groupBy("candidate_key").agg(*best, F.max(score).alias(score), ordered_values(source, position).alias("sources"))


def identity_keys(doc_id: str, source: str, number: str, title: str) -> list[Column]:
    filled = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.trim(F.col(c)))
    return [
        F.concat(F.lit("doc_id:"), filled(doc_id)), F.concat(F.lit("source_doc:"), filled(source), F.lit("|"), filled(number)),
        F.concat(F.lit("source_title:"), filled(source), F.lit("|"), F.upper(collapse(title))), F.concat(F.lit("title:"), F.upper(collapse(title))),
    ]


def duplicate_groups(rows: DataFrame, keys: list[str], unique: str, fields: list[str], sample: int = 3) -> DataFrame:
    """Groups of two or more: size, the first ids, and which fields differ inside."""
    kinds = [F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"_{f}") for f in fields]
    placed = rows.withColumn("_r", ranked(keys, F.asc(unique)))  # only the first ids are gathered, however large the group
    first = F.array_sort(F.collect_list(F.when(F.col("_r") <= sample, F.col(unique)))).alias("samples")
    grouped = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first, *kinds).filter("n > 1")
    return grouped.select(*keys, "n", "samples", F.array_join(reasons(*[(F.col(f"_{f}") > 1, f) for f in fields]), ";").alias("differing"))


def duplicate_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicated_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def keep_first(rows: DataFrame, keys: list[str], doc_id: str) -> DataFrame:
    """One row a key: smallest number at the end of doc_id, then doc_id; ids without one come last."""
    suffix = F.regexp_extract(F.col(doc_id).cast("string"), "([0-9]+)$", 1).try_cast("bigint")
    return rows.withColumn("_r", ranked(keys, suffix.asc_nulls_last(), F.asc(doc_id))).filter("_r = 1").drop("_r")


def majority(rows: DataFrame, by: list[str], value: str, name: str = "majority") -> DataFrame:
    """Most frequent non-blank value of each group; alphabetical on ties; blank where there is none."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    filled = F.coalesce(F.trim(F.col(value).cast("string")), F.lit("")) != ""
    best = F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name)
    found = counted.filter(filled).groupBy(*by).agg(best)
    return rows.select(*by).distinct().join(found, by, "left").withColumn(name, F.coalesce(F.col(name), F.lit("")))


def representative(by: list[str], score: Column, title: str, payload: list[str], rows: DataFrame) -> DataFrame:
    """The row of each group with the best score, then the shortest title, then the first in order."""
    row = F.min_by(F.struct(*payload), F.struct(-score, F.length(title), F.col(title))).alias("_row")
    return rows.groupBy(*by).agg(row, F.count(F.lit(1)).alias("n_source")).select(*by, "n_source", "_row.*")


def consolidate(rows: DataFrame, keys: list[str], position: str, joined: dict[str, str], context: list[str], status: str) -> DataFrame:
    """Groups in key order, numbered from 1: joined columns, a context value where the group agrees, combined status.

    A context column that varies within a group becomes `General`.
    """
    agreed = [F.when(F.count_distinct(F.when(F.col(c) != "", F.col(c))) <= 1, F.coalesce(F.max(F.when(F.col(c) != "", F.col(c))), F.lit(""))).otherwise("General").alias(c) for c in context]
    out = rows.groupBy(*keys).agg(*agreed, F.collect_set(position).alias("old_numbers"))
    told = rows.select(*keys, position, F.posexplode(F.split(F.coalesce(F.col(status), F.lit("")), "; ")).alias("_i", "_told")).filter("_told <> 'OK'")
    told = joined_values(told.withColumn("_place", F.struct(position, "_i")), keys, "_place", {"_told": "; "})
    out = with_group(with_group(out, joined_values(rows, keys, position, joined), keys), told, keys)
    out = out.withColumn(status, F.when(F.coalesce("_told", F.lit("")) == "", "OK").otherwise(F.col("_told"))).drop("_told")
    out = out.select(*keys, *joined, *context, status, "old_numbers")
    return numbered(out, [F.asc(k) for k in keys])


def numbered(rows: DataFrame, order: list[Column], name: str = "no") -> DataFrame:
    """Gapless numbers in a total order. Ranges are sorted in parallel; only their counts meet.

    The dealt ranges are written once: their bounds come from a sample, and two
    readings of one plan may deal rows into other ranges.
    """
    from dossier.sources.scratch import settled

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = settled(placed).withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1) + 1}).drop("_m")
    sizes = placed.groupBy("_p").agg(F.max("_i").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range
    return placed.join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p").withColumn(name, F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


#: Rows of distinct texts that are sent to all tasks.
FEW_ROWS = 1000


def joined_alike(rows: DataFrame, found: DataFrame, keys: Sequence[str], n_found: int) -> DataFrame:
    """rows with their row of found, which has n_found rows, one for each set of keys in rows; nulls are alike."""
    theirs = {c: f"_of_{c}" for c in keys}
    alike = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(other)) for c, other in theirs.items()])
    there = found.withColumnsRenamed(theirs)
    # a small table by its count: all rows of a table may have one of a few sets, which would meet in few tasks
    return rows.join(F.broadcast(there) if n_found <= FEW_ROWS else there, alike).drop(*theirs.values())


def renumber_audit(audit: DataFrame, consolidated: DataFrame, old: str, title: str) -> DataFrame:
    """Audit rows under their new number and title."""
    moved = consolidated.select("no", F.col(title).alias("new_title"), F.explode("old_numbers").alias(old))
    return audit.join(moved, old).drop(old).withColumnRenamed("no", "new_no")


def disambiguate(rows: DataFrame, title: str, scope: str, both: tuple[str, str], qualifier: Column) -> DataFrame:
    """Titles that occur in both scopes get a qualifier; the scopes of a title meet in an aggregate, not its rows."""
    held = rows.groupBy(title).agg(*[F.bool_or(F.col(scope) == x).alias(f"_{i}") for i, x in enumerate(both)])
    two = held.filter("_0 and _1").select(title, F.lit(True).alias("_two"))
    named = F.when(F.col("_two"), F.concat(F.col(title), F.lit(" ("), qualifier, F.lit(")"))).otherwise(F.col(title))
    return with_group(rows, two, [title]).withColumn(title, named).drop("_two")


def conservative_merge(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Of a proposed merge, rows with the group's majority key stay; the others are kept apart."""
    n = rows.groupBy(group, key).agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy(group).agg(F.min_by(key, F.struct(-F.col("_n"), F.col(key))).alias("_best"))
    return rows.join(best, group).withColumn("kept", F.col(key) == F.col("_best")).drop("_best")


def add_if_absent(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(extra.join(base.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def missing_pairs(required: DataFrame, titles: DataFrame, parts: list[str], title: str) -> DataFrame:
    """Required combinations that no title names: every part must be a substring.

    Substrings have no key to meet on, so required rows go to every title, in
    blocks of at most REQUIRED_BLOCK; found ones are removed by an anti join.
    """
    hit = None
    for p in parts:
        c = F.contains(F.lower(F.col(title)), F.lower(F.col(p)))
        hit = c if hit is None else hit & c
    blocks, found = max(1, -(-required.count() // REQUIRED_BLOCK)), None
    for b in range(blocks):
        block = required.filter(F.pmod(F.xxhash64(*parts), F.lit(blocks)) == b)
        some = titles.select(title).join(F.broadcast(block), hit).select(*parts).distinct()
        found = some if found is None else found.unionAll(some)
    return required.join(found, parts, "left_anti")


def composite_rows(rows: DataFrame, column: str, parts: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows whose value stands for several become one row a part."""
    split = ladder(*[(F.lower(F.col(column)) == k.lower(), F.array(*[F.lit(v) for v in vs])) for k, vs in parts.items()], otherwise=F.array(F.col(column)))
    return rows.withColumn(column, F.explode(split))


def initial_status(title: Column, scope: Column, n_equipment: Column, n_source: Column) -> Column:
    """`; `-joined review reasons of a grouped row, or OK."""
    key = F.lower(title)
    infra, vendor = "foundation|building|cable raceway|layout|road|drainage|underground", "datasheet|data sheet|performance curve|vendor ga|shop drawing"
    found = reasons((n_equipment == 0, "Generic Title"), (((scope == "Vendor") & key.rlike(infra)) | ((scope == "EPC") & (n_equipment > 0) & key.rlike(vendor)), "Scope Mixed"), (n_source > 8, "Possible Over-Merge"))
    return F.when(F.size(found) == 0, "OK").otherwise(F.array_join(found, "; "))


def vendor_summary(rows: DataFrame, by: str, project: str, amount: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(project).alias("n_projects"), F.round(F.max(amount), 2).alias("most"))


def package_of(text: Column, rules: Sequence[tuple[str, str]], otherwise: str = "Review Needed") -> Column:
    """First package whose pattern matches."""
    return ladder(*[(F.coalesce(text, F.lit("")).rlike(pattern), name) for name, pattern in rules], otherwise=otherwise)


# Package, its section and what its equipment is called, first hit wins; short names; equipment that has no package.
PACKAGES = (
    ("GT / GTG", "GT Vendor Document List", ("gas turbine", r"\bgt\b", "gtg")),
    ("ST / STG", "ST/STG Vendor Document List", ("steam turbine", r"\bst\b", "stg", "steam turbine generator")),
    ("Pump", "Pump Vendor Document List", (r"\bpump\b", r"\bbfp\b", r"\bcep\b", r"\bcwp\b", r"\bccwp\b", "vacuum pump", "feed water pump", "boiler feed pump")),
    ("Tank", "Tank Vendor Document List", (r"\btank\b", "deaerator")),
    ("Air / Gas Package", "Air/Gas Package Vendor Document List", ("air compressor", "compressed air", "fuel gas compressor", "fuel gas conditioning", "gas treatment", "hydrogen generation", "industrial gas")),
    ("Boiler / Heater / Cooler", "Boiler/Cooler Vendor Document List", ("boiler", "fin fan cooler", "air cooled heat exchanger", "heat exchanger", r"\bache\b")),
    ("Electrical Major Equipment", "Electrical Major Equipment Vendor Document List", (
        "transformer", "switchgear", "generator circuit breaker", r"\bgcb\b", r"\bgis\b", "air insulated switchgear", "motor control center", r"\bmcc\b", r"\bups\b", r"\bdc system\b", r"\bipbd\b", r"\bipb\b", "phase bus", r"\bais\b",
    )),
    ("Water Treatment Package", "Water Treatment Vendor Document List", ("water treatment", "waste water", r"\betp\b", r"\bswas\b", r"\bstp\b", r"\bows\b")),
    ("Diesel Generator Package", "Diesel Generator Vendor Document List", ("blackstart diesel generator", "emergency diesel generator", r"\bbsedg\b", r"\bedg\b", "diesel generator")),
    ("Cooling Tower Package", "Cooling Tower Vendor Document List", ("cooling tower",)),
    ("Condenser / CTCS", "Condenser Vendor Document List", ("condenser tube cleaning", "^condenser$", "water box vacuum pump", r"\bctcs\b")),
    ("Crane / Hoist Package", "Crane & Hoist Vendor Document List", ("crane", "hoist", "lifting device")),
    ("Valve Package", "Valve Vendor Document List", ("valve", "control valve", "prds", "safety relief valve", r"\bmov\b")),
    ("Instrument / Protection Package", "Instrument/Protection Vendor Document List", ("field instrument", "protection panel", "telecommunication panel", r"\bfms\b", "closed circuit television", r"\bcctv\b")),
    ("Cable / Tray Package", "Cable Vendor Document List", ("cable tray", r"\bcable\b", "cable termination", "cable raceway", "fiber optic")),
)
SHORT_EQUIPMENT = (
    ("Gas Turbine Generator", "GTG"), ("Steam Turbine Generator", "STG"), ("Generator Step[- ]Up Transformer", "GSUT"), ("Generator Circuit Breaker", "GCB"), ("Motor Control Center", "MCC"), ("Condensate Extraction Pump", "CEP"),
    ("Boiler Feed Pump", "BFP"), ("Closed Cooling Water Pump", "CCWP"), ("Circulating Water Pump", "CWP"), ("Water Box Vacuum Pump", "WBVP"), ("Condenser Vacuum Pump", "CVP"),
)
EXCLUDED_EQUIPMENT = ("acc", "air cooled condenser", "hrsg", "heat recovery steam generator", "dcs", "balance of plant", "bop")
PROJECT_QUALIFIERS = r"(?i)\s*\((?:[^)]*for\s+)?(?:block|unit|project)[^)]*\)|\(V\)|（V）|\[V\]|\[[^\]]+\]"


def equipment_name(raw: ColumnOrName) -> Column:
    """Without project qualifiers, known names in their short form."""
    out = F.trim(F.regexp_replace(F.regexp_replace(collapse(raw), PROJECT_QUALIFIERS, " "), "\\s+", " "))
    out = F.regexp_replace(out, "^[ _/,-]+|[ _/,-]+$", "")
    for name, short in SHORT_EQUIPMENT:
        out = F.regexp_replace(out, f"(?i)\\b{name}\\b", short)
    return out


def _name_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9가-힣]+", " "))


def vendor_package(raw: ColumnOrName) -> Column:
    """Struct (package, section, status) of an equipment name."""
    key = _name_key(equipment_name(raw))
    made = lambda p, s, how: F.struct(F.lit(p).alias("package"), F.lit(s).alias("section"), F.lit(how).alias("status"))
    return ladder(*[(key.rlike("|".join(patterns)), made(package, section, "mapped_by_rule")) for package, section, patterns in PACKAGES], otherwise=made("Review Needed", "", "needs_review"))


def excluded_equipment(raw: ColumnOrName) -> Column:
    """Equipment that vendor packages leave out, by its name before shortening."""
    bare = F.regexp_replace(collapse(raw), PROJECT_QUALIFIERS, " ")
    return _name_key(bare).isin(*EXCLUDED_EQUIPMENT)


KEEP_UPPER = ("P&ID", "HVAC", "UPS", "GT", "ST", "HRSG", "DCS")


def engineering_title(text: Column) -> Column:
    """Title case that keeps known acronyms, mixed case, `&` and `/`."""

    def word(w: Column) -> Column:
        mixed = (w != F.upper(w)) & (w != F.lower(w)) & (F.substring(w, 2, 1000) != F.lower(F.substring(w, 2, 1000)))
        keep = F.upper(w).isin(*KEEP_UPPER)
        return F.when(keep, F.upper(w)).when(mixed | w.contains("&") | w.contains("/"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))

    return F.array_join(F.transform(F.split(collapse(text), " "), word), " ")


def clean_register_row(rows: DataFrame, detected: dict[str, Column]) -> DataFrame:
    """Fill blank fields from detected values; note what was done.

    Adds actions (in field order), confidence (the least of each step's), and
    conflict where a filled field disagrees with what was detected.
    """
    steps = {"building": 0.85, "equipment": 0.8, "deliverable": 0.85}
    blank = {c: F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in detected}
    found = {c: F.coalesce(d, F.lit("")) for c, d in detected.items()}
    fills = {c: blank[c] & (found[c] != "") for c in detected}
    clash = {c: ~blank[c] & (found[c] != "") & (F.lower(F.trim(F.col(c))) != F.lower(found[c])) for c in detected}
    actions = reasons(*[(fills[c], f"filled_{c}") for c in detected])
    conflicts = reasons(*[(clash[c], f"{c}_conflict") for c in detected])
    least = F.least(F.lit(1.0), *[F.when(fills[c], steps.get(c, 0.9)).otherwise(1.0) for c in detected], F.when(F.size(conflicts) > 0, 0.35).otherwise(1.0))
    out = rows.withColumns({"actions": F.array_join(actions, ";"), "conflicts": F.array_join(conflicts, ";"), "confidence": least})
    return out.withColumns({c: F.when(fills[c], found[c]).otherwise(F.col(c)) for c in detected})
