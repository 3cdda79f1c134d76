"""Counts, run comparisons, risk and usability ladders, validation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.columns import ladder, ranked, reasons

TAU_LOW, TAU_HIGH, TAU_DEFAULT = 0.40, 0.90, 0.70


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, percent), blanks as EMPTY; the total is one row."""
    named = F.when(F.coalesce(F.trim(F.col(column)), F.lit("")) == "", "EMPTY").otherwise(F.col(column))
    counted = rows.groupBy(named.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    return counted.join(F.broadcast(total)).withColumn("percent", F.round(100.0 * F.col("n") / F.col("_total"), 2)).drop("_total")


def reason_counts(rows: DataFrame, column: str, separator: str = ";") -> DataFrame:
    parts = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), separator), lambda v: F.trim(v) != "")
    return rows.select(F.explode(F.transform(parts, lambda v: F.trim(v))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def run_delta(base: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """(value, base_n, new_n, delta) over the values of either run."""
    count = lambda df, name: df.groupBy(F.coalesce(F.col(column), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias(name))
    out = count(base, "base_n").join(count(new, "new_n"), "value", "full_outer").fillna(0, ["base_n", "new_n"])
    return out.withColumn("delta", F.col("new_n") - F.col("base_n"))


def transitions(base: DataFrame, new: DataFrame, key: str, status: str, good: str = "generated") -> DataFrame:
    """(gained, lost, changed, compared) of rows aligned by key."""
    both = base.select(key, F.col(status).alias("b")).join(new.select(key, F.col(status).alias("n")), key)
    return both.agg(
        F.count_if((F.col("b") != good) & (F.col("n") == good)).alias("gained"), F.count_if((F.col("b") == good) & (F.col("n") != good)).alias("lost"),
        F.count_if(F.col("b") != F.col("n")).alias("changed"), F.count(F.lit(1)).alias("compared"),
    )


def score_stats(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Count, mean, median, p10 and p90 by linear interpolation."""
    p = F.percentile(column, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.groupBy(*by).agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), p.alias("p"))
    return out.select(*by, "n", "mean", *[F.round(F.col("p")[i], 6).alias(name) for i, name in enumerate(("p10", "median", "p90"))])


def score_gaps(rows: DataFrame, key: str, mode: str, score: str, choice: str, base: str) -> DataFrame:
    """Per mode: rows, scores there are, their spread, and how they and the choices stand against the base mode's, row by row.

    A delta needs a score on both sides; four digits. rows: one a key and mode.
    """
    own = rows.filter(F.col(mode) == base).select(key, F.col(score).alias("_base"), F.col(choice).alias("_choice"))
    delta = F.round(F.col(score) - F.col("_base"), 9)
    both = rows.join(own, key, "left").withColumn("_delta", delta)
    spread = lambda c: F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = both.groupBy(mode).agg(
        F.count(F.lit(1)).alias("rows_total"), F.count(score).alias("score_available_rows"), F.avg(score).alias("mean"), spread(score).alias("s"), F.avg("_delta").alias("mean_delta"), F.percentile("_delta", F.lit(0.5)).alias("median_delta"),
        F.count_if(F.col("_delta") > 0).alias("positive_delta_rows"), F.count_if(F.col("_delta") < 0).alias("negative_delta_rows"), F.count_if(F.col("_delta") == 0).alias("zero_delta_rows"),
        F.count_if(~F.col(choice).eqNullSafe(F.col("_choice"))).alias("choice_changed_rows"),
    )
    four = lambda c: F.round(c, 4)
    return out.select(
        mode, "rows_total", "score_available_rows", F.round(100.0 * F.col("score_available_rows") / F.col("rows_total"), 2).alias("score_available_pct"), four("mean").alias("mean"), *[four(F.col("s")[i]).alias(n) for i, n in enumerate(("p10", "median", "p90"))],
        four("mean_delta").alias("mean_delta"), four("median_delta").alias("median_delta"), "positive_delta_rows", "negative_delta_rows", "zero_delta_rows", "choice_changed_rows",
    )


def gaps_by_reason(rows: DataFrame, reason: str, delta: str) -> DataFrame:
    """(reason, n, mean, median, position) of deltas; a blank reason is EMPTY; most frequent first, then by median."""
    from dossier.functions.columns import text_or_blank

    named = F.when(F.trim(text_or_blank(reason)) == "", "EMPTY").otherwise(F.col(reason))
    out = rows.groupBy(named.alias(reason)).agg(F.count(delta).alias("n"), F.round(F.avg(delta), 4).alias("mean"), F.round(F.percentile(delta, F.lit(0.5)), 4).alias("median"))
    # as many rows as there are kinds of reasons
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("median"), F.asc(reason))))


def suggested_threshold(values: DataFrame, column: str) -> DataFrame:
    """Middle of the largest gap between neighbouring values in [TAU_LOW, TAU_HIGH], earliest on ties; else the default.

    Neighbours are found within ranges of the sorted values; a range's first
    value looks at the previous range's last one, so ranges sort in parallel.
    """
    inside = values.select(F.col(column).cast("double").alias("v")).filter(F.col("v").between(TAU_LOW, TAU_HIGH)).distinct()
    spread = inside.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    edges = spread.groupBy("p").agg(F.max("v").alias("last"))
    before = edges.select("p", F.last("last", ignorenulls=True).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)).alias("edge"))
    lagged = F.coalesce(F.lag("v").over(Window.partitionBy("p").orderBy("v")), F.col("edge"))
    gaps = spread.join(before, "p").withColumn("prev", lagged).filter("prev is not null")
    best = gaps.agg(F.max_by((F.col("v") + F.col("prev")) / 2, F.struct(F.round(F.col("v") - F.col("prev"), 12), -F.col("v"))).alias("tau"))
    return best.select(F.round(F.coalesce("tau", F.lit(TAU_DEFAULT)), 3).alias("tau"))


def drop_stage(raw: Column, top: Column, score: Column, kept: Column, status: Column, generated: Column) -> Column:
    """The first stage at which a judged pair was lost."""
    return ladder(
        (~raw, "not_in_raw_matching"), (~top, "rank_beyond_top_n"), (~score, "below_score_threshold"), (~kept, "not_kept_after_candidate_extraction"),
        (F.lower(F.trim(F.coalesce(status, F.lit("")))) != "accepted", "candidate_needs_review"), (~generated, "not_generated"), otherwise="kept_and_generated",
    )


SEVERE = ("painting", "foundation")


def risk(status: Column, keyword: Column, query_family: Column, rule_family: Column, shared: Column, scope_shared: Column, has_scope: Column) -> Column:
    """Struct (level, reasons) of a generated row."""
    s = F.coalesce(status, F.lit(""))
    off = (query_family != "") & (rule_family != "") & (query_family != rule_family)
    severe = rule_family.isin(*SEVERE) & (query_family != rule_family)
    found = reasons(
        (s != "generated", F.concat(F.lit("date_status="), F.when(s == "", "blank").otherwise(s))), (F.trim(keyword) == "", "missing_rule_keyword"),
        (off, F.concat(F.lit("deliverable_family_mismatch:"), query_family, F.lit("->"), rule_family)), (severe, F.concat(F.lit("severe_rule_family:"), rule_family)),
        (shared == 0, "rule_token_no_overlap"), (has_scope & (scope_shared == 0), "activity_scope_no_overlap"),
    )
    high = F.exists(found, lambda r: r.startswith("date_status=") | r.startswith("severe_rule_family:") | r.contains("painting") | r.contains("foundation"))
    return F.struct(ladder((high, "high"), (F.size(found) > 0, "medium"), otherwise="low").alias("level"), F.array_join(found, ";").alias("reasons"))


def usability(date_status: Column, quality: Column) -> Column:
    d, q = F.coalesce(date_status, F.lit("")), F.coalesce(quality, F.lit(""))
    return ladder(
        (d == "generated", "generated"), (d == "fi_complete", "fi_complete"), ((d == "skip") | (q == "skip"), "skip"), (d.isin("missing_fa", "blocked_missing_date") | (q == "blocked_missing_date"), "partial"),
        (d.isin("no_rule", "blocked_no_rule") | (q == "blocked_no_rule"), "no_rule"), (d.startswith("blocked") | q.startswith("blocked"), "blocked"), otherwise="review",
    )


def coverage_bucket(blocked: Column, has_scope: Column, has_phase: Column, system_known: Column, cell_known: Column) -> Column:
    return ladder((~blocked, "not_blocked"), (~has_scope, "no_scope"), (~has_phase, "no_phase"), (~system_known, "system_absent"), (cell_known, "cell_covered"), otherwise="phase_gap")


def metrics(df: DataFrame, /, **columns: Column) -> DataFrame:
    """(metric, value) rows of one pass over the data."""
    one = df.agg(*[c.cast("double").alias(k) for k, c in columns.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in columns])).alias("m")).select("m.*")


def validation_rows(rows: DataFrame, status: str, unique: str) -> DataFrame:
    """One row a review reason that isn't OK."""
    return rows.select(unique, F.explode(F.split(F.col(status), "; ")).alias("issue")).filter("issue not in ('', 'OK')")


def carry_forward(rows: DataFrame, by: list[str], position: str, level: str, value: str, levels: int) -> DataFrame:
    """path columns level_0..: the latest value of each level, dropped once a shallower one is newer."""
    w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    seen = {f"_l{k}": F.last(F.when(F.col(level) == k, F.struct(F.col(position).alias("p"), F.col(value).alias("v"))), ignorenulls=True).over(w) for k in range(levels)}
    rows = rows.withColumns(seen)
    out = {}
    for k in range(levels):
        newer = F.lit(False)
        for j in range(k):
            newer = newer | F.coalesce(F.col(f"_l{j}.p") > F.col(f"_l{k}.p"), F.lit(False))
        out[f"level_{k}"] = F.when(~newer, F.col(f"_l{k}.v"))
    return rows.withColumns(out).drop(*seen)


def batches(rows: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """Adds batch and place: fixed-size runs in order."""
    n = ranked(by, *order) - 1
    return rows.withColumn("_n", n).withColumns({"batch": F.floor(F.col("_n") / size).cast("int"), "place": (F.col("_n") % size).cast("int")}).drop("_n")


def run_alignment(base: DataFrame, new: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """Rows of two runs paired by position within `by`, up to the shorter run; drift where keys differ."""
    place = lambda df, name: df.select(*by, F.col(key).alias(name), ranked(by, F.asc(order)).alias("position"))
    return place(base, "base_key").join(place(new, "new_key"), [*by, "position"]).withColumn("drift", F.col("base_key") != F.col("new_key"))


def section_order(section: str) -> list[Column]:
    """Numeric sections by number first, then others by name."""
    v = F.trim(F.col(section))
    return [v.rlike("^[0-9]+$").desc(), v.try_cast("bigint").asc_nulls_last(), v.asc()]
