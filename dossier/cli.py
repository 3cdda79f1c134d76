"""Command line: registered queries, and the pipelines from files to files.

    python -m dossier.cli query NAME FOLDER OUT     a registered query over a folder of tables
    python -m dossier.cli list                      names of the queries
    python -m dossier.cli titles FOLDER OUT         titles of the workbooks of a folder, one row a normalised title
    python -m dossier.cli chunk PATH OUT [--most N] chunks of the text files below a path
    python -m dossier.cli clean PATH OUT            chunk documents without their noise
    python -m dossier.cli schedule DOCS RULES ACTIVITIES OUT [--floor DATE] [--mapping FILE] [--mode text|structured|hybrid]
                                                    dated rows with a quality from a register, a rule file and an activity file
    python -m dossier.cli clean-register REGISTER OUT
                                                    register rows cleaned from their titles, with what was done; prints the counts
    python -m dossier.cli ingest FOLDER CATALOG NUMBER
                                                    titles of the workbooks of a folder, merged into a stored catalogue as its register of that number
    python -m dossier.cli match REQUIREMENTS CATALOG OUT [--retrieved N] [--shown N]
                                                    a match run of a requirement file over a catalogue file
    python -m dossier.cli rerank RUN OUT [--retrieved N] [--shown N]
                                                    a stored run's candidates ranked anew
    python -m dossier.cli structure PAGES OUT [--most N]
                                                    chunks of the HTML files below a path that follow their headings
    python -m dossier.cli export CATALOG OUT TERM.. catalogue rows that name a term
    python -m dossier.cli replace PATH INCOMING     replace a stored table; prints the rows that were there
    python -m dossier.cli empty PATH                delete all rows of a stored table; prints how many
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.plans import registry


def _titles(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from dossier.operators.listing import merge_titles
    from dossier.sources.office import register_titles, workbooks

    rows = register_titles(workbooks(spark, a.folder)).withColumn("position", F.struct("source_file", "sheet", "row"))
    return merge_titles(rows, "title", "position", {"source_file": " | ", "document_no": " | "}).drop("first_position")


def _chunk(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from dossier.operators.chunking import chunk_paragraphs

    texts = spark.read.text(a.path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return chunk_paragraphs(texts, "path", "value", a.most)


def _clean(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from dossier.sources.files import CHUNKS, cleaned_chunk_document

    return cleaned_chunk_document(spark.read.schema(CHUNKS).json(a.path, multiLine=True))


def _schedule(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from dossier.operators.providers import HashEmbedder, OverlapScorer
    from dossier.operators.schedule import CANDIDATE, FIELDS, generate_schedule
    from dossier.sources import files as S

    docs = S.read_csv(spark, a.docs).withColumnsRenamed({"Title": "title", "Equipment": "equipment", "System": "system", "Building": "building", "Deliverable": "deliverable", "Status": "candidate_status", "Match_Score": "match_score"})
    docs = S.with_columns_of(docs, [*FIELDS, *CANDIDATE]).withColumn("doc_id", F.abs(F.xxhash64(*FIELDS) % (1 << 61))).dropDuplicates(["doc_id"])
    rules = S.rules(spark, a.rules)
    activities = S.activities(spark, a.activities).withColumn("activity_id", F.xxhash64("activity_id", "activity_name"))
    mapping = S.domain_mapping(spark, a.mapping) if a.mapping else None
    out = generate_schedule(docs, rules, activities, OverlapScorer(), HashEmbedder(), mapping=mapping, mode=a.mode, floor=F.lit(a.floor).cast("date") if a.floor else None)
    records = [c for c in out.columns if c.startswith(("rule_match_", "activity_match_"))]
    return out.select("doc_id", "title", "rule_id", "activity_id", "activity_name", "resolution", *records, "date_status", "fa_earliest", "fa_recommended", "fa_latest", "fc_earliest", "fc_recommended", "fc_latest", "schedule_quality")


def _clean_register(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from dossier.operators import register_cleaning as C
    from dossier.sources import files as S
    from dossier.sources.scratch import settled

    held = S.read_csv(spark, a.register)
    names = {"title": "Title", "others": "Others"} | {c: c.capitalize() for c in C.FIELDS}
    rows = held.select(*[F.col(f"`{n}`") for n in held.columns if n not in names.values()], *[(F.col(f"`{n}`") if n in held.columns else F.lit("")).alias(c) for c, n in names.items()])
    cleaned = settled(C.cleaned_register(rows))
    for r in C.cleaning_summary(cleaned).orderBy("name").collect():  # a few kinds
        print(r["name"], r["n"])
    return cleaned


def _match(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from dossier.operators import match_run as M
    from dossier.operators.providers import HashEmbedder, OverlapScorer, embed_texts
    from dossier.sources import files as S

    asked = S.with_columns_of(S.read_csv(spark, a.requirements), ["chunk_id", "query", "is_candidate"]).withColumn("key", F.xxhash64("chunk_id"))
    catalog = S.with_columns_of(S.read_csv(spark, a.catalog), ["doc_id", "title", "text"]).withColumnRenamed("doc_id", "name")
    catalog = catalog.select(F.xxhash64("name").alias("doc_id"), F.concat_ws(" ", "title", "text").alias("text"), F.concat_ws(" | ", "name", "title").alias("display"))
    return M.match_run(embed_texts(asked, "query", HashEmbedder()), embed_texts(catalog, "text", HashEmbedder()), OverlapScorer(), a.retrieved, a.shown)


def _rerank(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from dossier.operators import match_run as M
    from dossier.operators.providers import OverlapScorer

    return M.rerank_run(spark.read.parquet(a.run), OverlapScorer(), a.retrieved, a.shown)


def _structure(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from dossier.operators.elements import chunk_elements, page_elements

    pages = spark.read.text(a.pages, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return chunk_elements(page_elements(pages, "path", "value"), a.most)


def _ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    """How many titles the catalogue holds after the register came in."""
    from dossier.operators.listing import merged_states, title_state
    from dossier.sources.office import register_titles, workbooks
    from dossier.sources.stored import KeyedTable

    rows = register_titles(workbooks(spark, a.folder))
    # registers stand in order of their number, a register's rows in that of file, sheet and row
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("sheet", "row"))
    files = rows.select("source_file").distinct().withColumn("f", F.row_number().over(Window.orderBy("source_file")))  # a register's files
    rows = rows.withColumn("p", place).join(F.broadcast(files), "source_file").withColumn("position", F.lit(a.number).cast("long") * (1 << 50) + F.col("f").cast("long") * (1 << 32) + F.col("p"))
    table = KeyedTable(spark, a.catalog, "title_key")
    table.upsert(title_state(rows, "title", "position", ["source_file", "document_no"]), merged_states)
    return table.read().count()


def _export(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from dossier.sources.files import export_catalog

    table = spark.read.parquet(a.catalog)
    words = [f.name for f in table.schema.fields if f.dataType.typeName() == "string"]
    return export_catalog(table, a.terms, words, words)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="dossier", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for p in positional:
            sub.add_argument(p)
        return sub

    command("query", "name", "folder", "out")
    command("list")
    command("titles", "folder", "out")
    command("chunk", "path", "out").add_argument("--most", type=int, default=512)
    command("clean", "path", "out")
    schedule = command("schedule", "docs", "rules", "activities", "out")
    schedule.add_argument("--floor")
    schedule.add_argument("--mapping")
    schedule.add_argument("--mode", default="hybrid", choices=("text", "structured", "hybrid"))
    command("clean-register", "register", "out")
    command("ingest", "folder", "catalog").add_argument("number", type=int)
    command("structure", "pages", "out").add_argument("--most", type=int, default=512)
    for runs in (command("match", "requirements", "catalog", "out"), command("rerank", "run", "out")):
        runs.add_argument("--retrieved", type=int, default=100)
        runs.add_argument("--shown", type=int, default=20)
    command("export", "catalog", "out").add_argument("terms", nargs="+")
    command("replace", "path", "incoming")
    command("empty", "path")
    return out


def main(args: list[str]) -> int:
    a = parser().parse_args(args)
    registry.load()
    if a.command == "list":
        print(*sorted(registry.QUERIES), sep="\n")
        return 0
    if a.command == "query" and a.name not in registry.QUERIES:
        print(f"no query {a.name}; `list` names them", file=sys.stderr)
        return 2
    from dossier.sources import files

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in ("replace", "empty"):
        print(files.emptied(spark, a.path) if a.command == "empty" else files.replaced(spark, a.path, spark.read.parquet(a.incoming)))
        return 0
    if a.command == "ingest":
        print(_ingest(spark, a))
        return 0
    makers = {"clean-register": _clean_register, "match": _match, "rerank": _rerank, "structure": _structure, "titles": _titles, "chunk": _chunk, "clean": _clean, "schedule": _schedule, "export": _export}
    df = registry.QUERIES[a.name](spark, a.folder) if a.command == "query" else makers[a.command](spark, a)
    df.write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
