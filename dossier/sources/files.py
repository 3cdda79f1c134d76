"""CSV, JSON and graph files in and out."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.columns import strings, text_or_blank
from dossier.functions.dates import parse_validation_time
from dossier.functions.text import blank_to_null, split_list
from dossier.operators.filters import touches_pages, without_noise

FALLBACK_ENCODING = "cp949"
BAD_CHARACTER = "�"
# Submission codes of rule files.
SUBMISSION = {"for approval": "FA", "fa": "FA", "for construction": "FC", "fc": "FC", "for information": "FI", "fi": "FI", "as built": "SKIP", "skip": "SKIP"}
CHUNKS = "chunks array<struct<chunk_id string, page_num array<int>, section string, section_path array<int>, chunk_type string, label array<string>, hierarchy_context string, text string>>"


def _rows_of(separator: str):
    """Arrow mapper: (path, content) of whole files that aren't UTF-8 to rows (path, place, cells), by their own charset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    content.decode("utf-8")
                    continue
                except UnicodeDecodeError:
                    rows = [*csv.reader(io.StringIO(content.decode(FALLBACK_ENCODING, "replace"), newline=""), delimiter=separator)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["path", "place", "cells"])

    return run


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as text, blanks and `nan` as null; a file that isn't UTF-8 is decoded as FALLBACK_ENCODING, the others are not."""
    df = spark.read.csv(path, header=True, sep=separator, multiLine=True, escape='"', encoding="utf-8")
    names = [c.lstrip("\ufeff").strip() for c in df.columns]
    broken = F.exists(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]), lambda v: v.contains(BAD_CHARACTER))
    marked = df.withColumns({"_path": F.col("_metadata.file_path"), "_broken": broken | F.lit(any(BAD_CHARACTER in c for c in df.columns))})
    if not marked.filter("_broken").isEmpty():
        # Spark's reader has no such charset; whole files of it are decoded in Arrow batches
        files = spark.read.format("binaryFile").load(path).select("path", "content")
        rows = files.mapInArrow(_rows_of(separator), "path string, place int, cells array<string>")
        heads = rows.filter("place = 0").select("path", F.transform("cells", lambda c: F.trim(F.regexp_replace(c, "^\ufeff", ""))).alias("heads"))
        # every file keeps its own header; the columns asked for are those of the first header by path
        names = heads.orderBy("path").first()["heads"] if any(BAD_CHARACTER in c for c in df.columns) else names
        own = rows.filter("place > 0").join(heads, "path").select(*[F.get("cells", F.array_position("heads", F.lit(n)).cast("int") - 1).alias(n) for n in names])
        bad = rows.select("path").distinct()
        good = marked.join(bad, F.regexp_replace("_path", "^file:/+", "/") == F.regexp_replace("path", "^file:/+", "/"), "left_anti").select(*[f"`{c}`" for c in df.columns]).toDF(*names)
        df = good.unionByName(own)
    df = df.toDF(*names)
    return df.select(*[blank_to_null(f"`{c}`").alias(c) for c in df.columns])


def with_columns_of(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; absent ones are blank."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit("").alias(n) for n in names])


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Validation rules of a `;`-separated file, in file order as rule_id.

    Rows need a numeric priority and a keyword. A blank submission code follows
    from the formula: FA where it parses, else SKIP.
    """
    raw = read_csv(spark, path, ";").withColumn("rule_id", F.monotonically_increasing_id())
    formula = parse_validation_time("Validation Time")
    code = F.create_map(*[F.lit(x) for p in SUBMISSION.items() for x in p])[F.lower(text_or_blank("`Pur.`"))]
    inferred = F.when(text_or_blank("`Pur.`") == "", F.when(formula["valid"], "FA").otherwise("SKIP")).otherwise(F.coalesce(code, F.lit("UNKNOWN")))
    kept = raw.filter(F.col("Priority").rlike("^[0-9]+$") & (text_or_blank("MDL Document Keyword") != ""))
    return kept.select("rule_id", F.col("Priority").cast("int").alias("priority"), text_or_blank("Item").alias("item"), F.col("MDL Document Keyword").alias("doc_keyword"), split_list("Activity Keyword", "\\|").alias("activity_keywords"), inferred.alias("sub_type"), text_or_blank("Validation Time").alias("formula"), formula.alias("vt"))


def clean_rules(raw: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, changes): first line only, non-breaking spaces to spaces, trimmed; one change row a cell."""
    cleaned = {c: F.trim(F.substring_index(F.translate(text_or_blank(f"`{c}`"), " ", " "), "\n", 1)) for c in columns}
    both = raw.withColumns({f"_{i}": cleaned[c] for i, c in enumerate(columns)})
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text_or_blank(f"`{c}`").alias("before"), F.col(f"_{i}").alias("after")) for i, c in enumerate(columns)])
    changes = both.select(key, F.explode(cells).alias("c")).select(key, "c.*").filter("before <> after")
    return both.select(*[F.col(f"_{columns.index(c)}").alias(c) if c in columns else F.col(f"`{c}`") for c in raw.columns]), changes


def activities(spark: SparkSession, path: str) -> DataFrame:
    """Rows of type activity from `{rows: [...]}`."""
    shape = "rows array<struct<row_type string, activity_id string, activity_name string, activity_name_clean string, wbs_path string, start_date string, finish_date string>>"
    rows = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("rows").alias("r")).select("r.*")
    return rows.filter("row_type = 'activity'").withColumns({c: F.col(c).try_cast("date") for c in ("start_date", "finish_date")})


def domain_mapping(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    lowered = lambda c: F.lower(F.trim(F.col(c)))
    return df.select(lowered("deliverable_family").alias("family"), F.coalesce(lowered("scope_family"), F.lit("*")).alias("scope"), F.transform(split_list("allowed_activity_phases", "\\|"), lambda v: F.lower(v)).alias("phases"))


def chunks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Chunks that touch the page range and can hold a requirement."""
    rows = spark.read.schema(CHUNKS).json(path, multiLine=True).select(F.explode("chunks").alias("c")).select("c.*")
    return without_noise(rows.filter(touches_pages("page_num", first, last)))


def cleaned_chunk_document(df: DataFrame) -> DataFrame:
    """The same nested document without noise chunks, changed in place."""
    plain = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), "[\\x09-\\x0D\\x20]+", "")
    keep = lambda c: ~F.lower(F.coalesce(c["chunk_type"], F.lit(""))).isin("separator", "toc") & ~F.coalesce(F.array_contains(c["label"], "document_index"), F.lit(False)) & (F.length(plain(c["text"])) >= 80)
    return df.withColumn("chunks", F.filter("chunks", keep))


#: Rows that a file's reader hands on at a time.
ROWS_A_BATCH = 2000
ARTIFACT = "path string, row int, cells map<string,string>, rank int, fields map<string,string>"
_MATCHED = re.compile(r"Matched_Doc_(\d+)(?:_(.+))?")


def _artifact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file by its own header, as many matched columns as it has; some rows at a time."""
    kinds = (pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.map_(pa.string(), pa.string()))
    shown = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "row", "cells", "rank", "fields"])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = io.TextIOWrapper(io.BytesIO(content.as_buffer().to_pybytes()), encoding="utf-8-sig", newline="")
            out, named = [], {}
            for number, row in enumerate(csv.DictReader(text), 1):
                named = named or {c: _MATCHED.fullmatch(c) for c in row if isinstance(c, str)}
                found: dict[int, dict[str, str]] = {}
                for c, m in named.items():
                    if m and (row[c] or "").strip():
                        found.setdefault(int(m[1]), {})[(m[2] or "display").lower()] = row[c].strip()
                cells = [(c, row[c] or "") for c, m in named.items() if not m]
                out += [(path, number, cells, rank, list(found[rank].items())) for rank in sorted(found)]
                if len(out) >= ROWS_A_BATCH:
                    yield shown(out)
                    out = []
            if out:
                yield shown(out)


def match_artifacts(spark: SparkSession, folder: str, pattern: str = "output_match_*.csv") -> DataFrame:
    """(path, row, document, chunk_id, cells, rank, doc_id, display, fields) of every file of that name below a folder.

    A file is read by its own header: every `Matched_Doc_n` and `Matched_Doc_n_Field`
    there is, however many. `fields` holds a match's named columns in lower case,
    `cells` the row's others. Rows without candidates vanish.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    rows = files.select("path", "content").mapInArrow(_artifact_rows, ARTIFACT)
    return rows.select("path", "row", F.col("cells")["Document"].alias("document"), F.col("cells")["Chunk ID"].alias("chunk_id"), "cells", "rank", F.col("fields")["doc_id"].alias("doc_id"), F.col("fields")["display"].alias("display"), "fields")


def write_matches(matches: DataFrame, folder: str, query: str = "query_id", most: int = 20) -> None:
    """Long matches (query, rank, doc_id, display) as JSON lines and as one wide CSV row a query."""
    matches.write.mode("overwrite").json(f"{folder}/json")
    wide = [F.max(F.when(F.col("rank") == i, F.col("display"))).alias(f"Matched_Doc_{i}") for i in range(1, most + 1)]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d")))), lambda s: s["d"]), "|")
    matches.filter(F.col("rank") <= most).groupBy(query).agg(*wide, ids.alias("Matched_Doc_IDs")).write.mode("overwrite").csv(f"{folder}/csv", header=True)


def sectioned(groups: DataFrame, section: str, columns: list[str], order: str) -> DataFrame:
    """One sheet of sections: a title row, a header row, then the rows; sort by section, kind, place to print."""
    rows = groups.select(F.col(section).alias("section"), F.lit(2).alias("kind"), F.col(order).cast("long").alias("place"), F.array(*[F.col(c).cast("string") for c in columns]).alias("cells"))
    names = groups.select(F.col(section).alias("section")).distinct()
    titles = names.select("section", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), F.array(F.col("section").cast("string")).alias("cells"))
    heads = names.select("section", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("place"), strings(columns).alias("cells"))
    return titles.unionByName(heads).unionByName(rows)


def upsert(existing: DataFrame | None, incoming: DataFrame, key: str, position: str) -> DataFrame:
    """The latest row of each key; all incoming rows are later than existing ones."""
    from dossier.functions.columns import ranked

    rows = incoming.withColumn("_age", F.lit(0))
    if existing is not None:
        rows = rows.unionByName(existing.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn("_r", ranked([key], F.asc("_age"), F.desc(position))).filter("_r = 1").drop("_r", "_age")


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def export_catalog(df: DataFrame, terms: list[str], columns: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """Rows with any term inside any of the columns, case ignored; the limit is the feature."""
    if terms:
        hit = F.lit(False)
        for c in columns:
            for term in terms:
                hit = hit | F.contains(F.lower(text_or_blank(c)), F.lower(F.lit(term)))
        df = df.filter(hit)
    out = df.orderBy(*order)
    return out if most is None else out.limit(most)


def export_graph(nodes: DataFrame, relations: DataFrame, folder: str) -> None:
    """nodes(id, labels, props) and rels(src, dst, type, props) as JSON lines, with their schemas beside them."""
    for name, df in (("nodes", nodes), ("rels", relations)):
        df.write.mode("overwrite").json(f"{folder}/{name}")
        df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string").write.mode("overwrite").text(f"{folder}/{name}_schema")


def import_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    import json

    from pyspark.sql.types import StructType

    read = lambda name: spark.read.schema(StructType.fromJson(json.loads(spark.read.text(f"{folder}/{name}_schema").first()[0]))).json(f"{folder}/{name}")
    return read("nodes"), read("rels")


def graph_differences(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, name, left_n, right_n) of label sets and relation types whose counts differ."""
    labels = lambda df: df.select(F.lit("node").alias("kind"), F.array_join(F.array_sort("labels"), ":").alias("name"))
    types = lambda df: df.select(F.lit("rel").alias("kind"), F.col("type").alias("name"))
    count = lambda g, n: labels(g[0]).union(types(g[1])).groupBy("kind", "name").agg(F.count(F.lit(1)).alias(n))
    return count(a, "left_n").join(count(b, "right_n"), ["kind", "name"], "full_outer").fillna(0, ["left_n", "right_n"]).filter("left_n <> right_n")


def replaced(spark: SparkSession, path: str, df: DataFrame) -> int:
    """Replace a stored table by df; the number of rows that were there before."""
    held = table_or_none(spark, path)
    before = 0 if held is None else held.count()
    df.write.mode("overwrite").parquet(path)
    return before


def emptied(spark: SparkSession, path: str) -> int:
    """Delete all rows of a stored table, keep its schema; the number of rows deleted."""
    held = table_or_none(spark, path)
    return 0 if held is None else replaced(spark, path, spark.createDataFrame([], held.schema))


def write_csv_with_mark(df: DataFrame, folder: str, columns: list[str]) -> None:
    """CSV files of the named columns, in order, absent ones blank, each file begun by a byte order mark (in its first header)."""
    out = with_columns_of(df, columns).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns])
    out.withColumnRenamed(columns[0], "\ufeff" + columns[0]).write.mode("overwrite").csv(folder, header=True, quoteAll=True, escape='"', emptyValue="")


def write_json_document(df: DataFrame, folder: str, metadata: DataFrame, order: str) -> None:
    """`{metadata, rows}` split for scale: metadata as one JSON line, rows as JSON lines in order."""
    metadata.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")
    df.orderBy(order).write.mode("overwrite").json(f"{folder}/rows")


def chunk_documents(chunks: DataFrame, source: str, most: int) -> DataFrame:
    """(document_id, source_path, max_tokens, chunk_count, chunks) of each document: the persisted chunk payload."""
    fields = [c for c in chunks.columns if c != "document_id"]
    listed = F.array_sort(F.collect_list(F.struct("place", *[c for c in fields if c != "place"])))
    found = chunks.groupBy("document_id").agg(listed.alias("chunks"))
    return found.select("document_id", F.concat(F.lit(source), F.col("document_id").cast("string")).alias("source_path"), F.lit(most).alias("max_tokens"), F.size("chunks").alias("chunk_count"), "chunks")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that hold one JSON list each, beside CSV files of the same fields."""
    return spark.read.schema(schema).json(path, multiLine=True)


def sections_of_modes(files: DataFrame, prefix: str, suffix: str = ".csv") -> DataFrame:
    """(section) of artifacts `mode/prefix<section>suffix` that every mode has; files: mode, name."""
    named = files.filter(F.col("name").startswith(prefix) & F.col("name").endswith(suffix))
    found = named.select("mode", F.expr(f"substring(name, {len(prefix) + 1}, length(name) - {len(prefix) + len(suffix)})").alias("section"))
    modes = files.select("mode").distinct().agg(F.count(F.lit(1)).alias("modes"))
    return found.groupBy("section").agg(F.count_distinct("mode").alias("n")).join(F.broadcast(modes), F.col("n") == F.col("modes")).select("section")
