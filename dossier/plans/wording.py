"""Text filters, vocabularies and classification ladders over documents, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.functions import vocabulary as V
from dossier.functions.columns import distinct_ignoring_case, reasons
from dossier.operators import filters as P
from dossier.plans.registry import Tables, query

#: Register-like wording for the tables at hand: words of a part's name stand for equipment, its type for a deliverable.
TITLES = {"ring": "GT ENCLOSURE LAYOUT DRAWING", "widget": "HRSG P&ID", "bolt": "CABLE SCHEDULE FOR UPS", "gear": "STEAM TURBINE DATA SHEET", "panel": "FIRE ALARM SYSTEM STUDY REPORT", "valve": "FEED WATER TECHNICAL SPECIFICATION"}


def titled_parts(t: Tables) -> DataFrame:
    """(p_partkey, title, deliverable, scope): each name's words in capitals, after the wording that its last word stands for."""
    last = F.element_at(F.split("p_name", " "), -1)
    named = F.coalesce(F.create_map(*[F.lit(x) for p in TITLES.items() for x in p])[last], F.lit("GENERAL NOTES"))
    return t.part.select("p_partkey", F.concat_ws(" - ", F.upper("p_name"), named).alias("title"), F.col("p_type").alias("deliverable"), F.concat_ws(" ", "p_brand", F.when(F.col("p_size") % 3 == 0, "HVAC")).alias("scope"))


TITLED = """tp AS (SELECT p_partkey, upper(p_name) || ' - ' || CASE split_part(p_name, ' ', -1) """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items()) + """ ELSE 'GENERAL NOTES' END AS title,
  p_type AS deliverable, CASE WHEN p_size % 3 = 0 THEN p_brand || ' HVAC' ELSE p_brand END AS scope FROM part)"""


def _has(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in terms) + ")"


@query(r"""SELECT doc_id, length(c) AS n_packed, n_letters, CASE WHEN length(c) < 80 THEN 'short' WHEN n_letters < 20 OR n_letters / length(c) < 0.25 THEN 'not_text' END AS noise
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]+', '', 'g') AS c, length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) AS n_letters FROM documents) WHERE length(c) > 0""")
def noise_filter(t: Tables) -> DataFrame:
    return P.text_noise(t.documents.select("doc_id", "text"), "text").filter("n_packed > 0").drop("text")


@query("SELECT event_id, NOT coalesce(lower(trim(event_type)), '') IN ('false', 'no', 'n', '0', 'error') AS kept FROM events")
def candidate_flag_filter(t: Tables) -> DataFrame:
    flag = F.when(F.col("event_type") == "error", F.lit(" No ")).otherwise(F.col("event_type"))
    return t.events.select("event_id", T.is_yes(flag).alias("kept"))


ALIAS_SQL = "list_sort(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(upper(title), '(^|[^A-Z0-9])(" + "|".join(a.replace("&", "&") for a in al) + f")([^A-Z0-9]|$)') THEN '{k}' END" for k, al in V.SCOPES) + "], lambda x: x IS NOT NULL))"


@query(f"WITH {TITLED} SELECT p_partkey, {ALIAS_SQL} AS scopes FROM tp")
def alias_scope_keys(t: Tables) -> DataFrame:
    return titled_parts(t).select("p_partkey", V.scope_keys("title").alias("scopes"))


def _key_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(upper({x}), '&', ' AND'), '[^A-Z0-9]+', ' ', 'g'))"


FAMILY_SQL = f"""WITH {TITLED}, k AS (SELECT *, {_key_sql("deliverable || ' ' || title")} AS x FROM tp)
SELECT p_partkey, CASE """ + " ".join(f"WHEN {_has('x', [V._plain(p) for p in ps])} THEN '{f}'" for f, _, ps in V.FAMILIES) + " ELSE 'other' END AS family, CASE " + " ".join(
    f"WHEN {_has('x', [V._plain(p) for p in ps])} THEN '{s}'" for _, s, ps in V.FAMILIES) + f" ELSE replace(lower({_key_sql('deliverable')}), ' ', '_') END AS subtype FROM k"


@query(FAMILY_SQL)
def family_ladder(t: Tables) -> DataFrame:
    return titled_parts(t).select("p_partkey", V.deliverable_type("deliverable", "title").alias("d")).select("p_partkey", "d.family", "d.subtype")


def _phase_sql() -> str:
    either = lambda ws: f"({_has('x', ws)} OR {_has('w', ws)})"
    steps = [f"WHEN {_has('x', ts)} THEN '{k}'" for k, ts in V.QUERY_PHASES]
    study, drawing = _has("x", V.STUDY_WORDS), _has("x", V.DRAWING_WORDS)
    steps += [f"WHEN {study} AND {either(V.CIVIL_WORDS)} THEN 'civil_design'", f"WHEN {study} AND {either(V.STUDY_SYSTEM_WORDS)} THEN 'system_design'"]
    steps += [f"WHEN {_has('x', ('SITE PLAN', 'PLOT PLAN'))} THEN 'civil_design'", f"WHEN {drawing} AND {either(V.CIVIL_DRAWING_WORDS)} THEN 'civil_design'"]
    steps += [f"WHEN {drawing} AND {either(V.SYSTEM_DRAWING_WORDS)} THEN 'system_design'", f"WHEN {drawing} AND contains(x, 'GENERAL ARRANGEMENT') AND trim(w) <> '' THEN 'system_design'"]
    steps += [f"WHEN {_has('x', ts)} THEN '{k}'" for k, ts in V.LATE_PHASES]
    return "CASE " + " ".join(steps) + " ELSE '' END"


ACTIVITY_SQL = "CASE " + " ".join(f"WHEN {_has('x', ts)} THEN '{k}'" for k, ts in V.ACTIVITY_PHASES) + " ELSE '' END"
STATUS_SQL = "CASE WHEN q = '' THEN 'query_unknown' WHEN a = '' THEN 'activity_unknown' WHEN q = a THEN 'match' WHEN (q, a) IN (" + ", ".join(f"('{x}', '{y}')" for x, y in V.COMPATIBLE_PHASES) + ") THEN 'compatible' ELSE 'mismatch' END"


@query(f"""WITH {TITLED}, k AS (SELECT *, upper(deliverable || ' ' || title) AS x, upper(scope) AS w FROM tp), p AS (SELECT p_partkey, {_phase_sql()} AS q, {ACTIVITY_SQL} AS a FROM k)
SELECT p_partkey, q AS query_phase, a AS activity_phase, {STATUS_SQL} AS status FROM p""")
def phase_ladder(t: Tables) -> DataFrame:
    both = F.concat_ws(" ", "deliverable", "title")
    out = titled_parts(t).select("p_partkey", V.query_phase("deliverable", "title", "scope").alias("query_phase"), V.activity_phase(both).alias("activity_phase"))
    return out.withColumn("status", V.phase_status("query_phase", "activity_phase"))


@query(r"""SELECT doc_id, len(list_distinct(ts)) AS n_tokens, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, ts)) / greatest(len(w), 3) ELSE 0 END, 6) AS recall
FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9&]+'), lambda t: length(t) >= 2) AS ts, ['the', 'of', 'system', 'and'] AS w FROM documents)""")
def token_recall(t: Tables) -> DataFrame:
    tokens = T.rule_tokens("text")
    wanted = F.array(*[F.lit(x) for x in ("the", "of", "system", "and")])
    return t.documents.select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.round(T.token_recall(wanted, tokens), 6).alias("recall"))


@query(r"""SELECT p_partkey, trim(regexp_replace(translate('a>' || p_name || chr(9) || '_' || p_type || '  x', '>_' || chr(9) || chr(13) || chr(10), '     '), ' +', ' ', 'g')) AS spaced,
  replace(lower(trim(regexp_replace(replace(upper(p_name || ' & ' || p_brand), '&', ' AND'), '[^A-Z0-9]+', ' ', 'g'))), ' ', '_') AS slug,
  sha1(p_name)[1:12] AS h1, sha256(p_name)[1:16] AS h2, 'title_' || sha1(lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))))[1:12] AS title_id FROM part""")
def keys_and_hashes(t: Tables) -> DataFrame:
    spaced = T.normalize_space(F.concat(F.lit("a>"), "p_name", F.lit("\t_"), "p_type", F.lit("  x")))
    return t.part.select("p_partkey", spaced.alias("spaced"), T.slug(F.concat("p_name", F.lit(" & "), "p_brand")).alias("slug"), T.short_sha1("p_name").alias("h1"), T.short_sha256("p_name").alias("h2"), T.title_id("p_name").alias("title_id"))


@query("""SELECT event_id, CASE WHEN k = 0 OR k IS NULL THEN '' ELSE printf('%.2f', k) END AS shown, coalesce(least(3, greatest(0, k::INT)), 0) AS bounded, (k IS NULL) AS missing
FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def json_extract(t: Tables) -> DataFrame:
    k = F.from_json(T.without_fence(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "k double")["k"]
    out = t.events.select("event_id", k.alias("k"))
    return out.select("event_id", T.fixed("k", 2).alias("shown"), T.bounded_int(F.col("k").cast("string"), 0, 3).alias("bounded"), F.col("k").isNull().alias("missing"))


@query("""WITH w AS (SELECT user_id, list(trim(event_type) ORDER BY event_id) AS v FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS e0 FROM events) GROUP BY user_id),
x AS (SELECT user_id, e0, event_id, row_number() OVER (PARTITION BY user_id, lower(e0) ORDER BY event_id) AS r FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS e0 FROM events))
SELECT user_id, list(e0 ORDER BY event_id) AS kinds FROM x WHERE r = 1 GROUP BY user_id""")
def ordered_distinct_ci(t: Tables) -> DataFrame:
    from dossier.functions.columns import ordered_values

    spelled = t.events.withColumn("e", F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return spelled.groupBy("user_id").agg(distinct_ignoring_case(ordered_values("e", "event_id")).alias("kinds"))


RULES = [("GT", "GAS TURBINE"), ("GAS", "NATURAL GAS"), ("UPS", "POWER SUPPLY"), ("P&ID", "PIPING DIAGRAM")]


def _abbreviation_sql() -> str:
    out = "title"
    for short, full in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        # no look-behind in this dialect: neighbours are kept by groups, twice for overlapping ones
        for _ in range(2):
            out = f"regexp_replace({out}, '(?i)(^|[^A-Z0-9]){short}([^A-Z0-9]|$)', '\\1{full}\\2', 'g')" if full.find(short) < 0 or short != "GAS" else out
        if short == "GAS":
            out = f"replace(regexp_replace({out}, '(?i)(^|[^A-Z0-9])GAS([^A-Z0-9]|$)', '\\1NATURAL @@\\2', 'g'), '@@', 'GAS')"
    return out


@query(f"WITH {TITLED} SELECT p_partkey, {_abbreviation_sql()} AS expanded FROM tp")
def abbreviation_chain(t: Tables) -> DataFrame:
    return titled_parts(t).select("p_partkey", T.expand_abbreviations("title", RULES).alias("expanded"))


@query("""SELECT o_orderkey, CASE WHEN len(r) = 0 THEN 'accepted' ELSE 'needs_review' END AS status, list_aggregate(r, 'string_agg', ';') AS issues FROM (
SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus = 'F' THEN 'missing_title' END, CASE WHEN o_totalprice < 50000 THEN 'missing_scope' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'missing_deliverable' END], lambda x: x IS NOT NULL) AS r FROM orders)""")
def candidate_quality(t: Tables) -> DataFrame:
    issues = reasons((F.col("o_orderstatus") == "F", "missing_title"), (F.col("o_totalprice") < 50000, "missing_scope"), (F.col("o_orderpriority") == "5-LOW", "missing_deliverable"))
    out = t.orders.select("o_orderkey", issues.alias("r"))
    return out.select("o_orderkey", F.when(F.size("r") == 0, "accepted").otherwise("needs_review").alias("status"), F.when(F.size("r") > 0, F.array_join("r", ";")).alias("issues"))


@query(r"""SELECT c_custkey, (regexp_matches(c_name, '[0-9]') AND regexp_matches(c_name, '[-_/&~]') AND length(regexp_replace(c_name, '[^\p{L}]', '', 'g')) >= 2 AND length(c_name) >= 10) AS by_name,
  regexp_matches(x, '(?i)^(T[0-9]{4,}|DOC_[0-9]+)') OR (regexp_matches(x, '[0-9]') AND regexp_matches(x, '[-_/&~]') AND length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= 2 AND length(x) >= 10) AS by_code
FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'DOC_' || c_custkey ELSE c_mktsegment || '-' || c_nationkey END AS x FROM customer)""")
def document_code(t: Tables) -> DataFrame:
    code = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("DOC_"), F.col("c_custkey"))).otherwise(F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey")))
    return t.customer.select("c_custkey", V.looks_like_code("c_name").alias("by_name"), V.looks_like_code(code).alias("by_code"))


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority AS p FROM orders)
SELECT o_orderkey, list_aggregate(list_transform([x], lambda v: '"' || v || '"'), 'string_agg', ' OR ') AS q, 'Label: ' || x || ' | Kind: ' || p AS labelled FROM (SELECT *, p || ' order' AS x FROM a)""")
def query_builders(t: Tables) -> DataFrame:
    x = F.concat("o_orderpriority", F.lit(" order"))
    return t.orders.select("o_orderkey", T.phrase_query(F.array(x)).alias("q"), T.labelled_text([("Label", x), ("Kind", "o_orderpriority"), ("Blank", F.lit(""))]).alias("labelled"))


@query("""SELECT supplier.s_suppkey, list_sort(list_distinct(list_filter([lower(trim(x)) FOR x IN string_split(n_name || '_' || s_name, '_')], lambda v: v <> ''))) AS parts
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def split_lists(t: Tables) -> DataFrame:
    both = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return both.select("s_suppkey", F.array_sort(F.array_distinct(F.transform(T.split_list(F.concat("n_name", F.lit("_"), "s_name"), "_"), lambda v: F.lower(v)))).alias("parts"))
