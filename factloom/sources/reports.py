"""Sinks: whole relations as tables, a document or report for each repository, and a console summary; written by executors."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from factloom.functions.expressions import first_rows
from factloom.operators import threats
from factloom.operators.signals import Result

# Sections that every document has.
REVIEW_SECTIONS = ("schema_version", "root", "system_overview", "evidence_class_counts", "surfaces", "strengths", "weaknesses", "risk_hotspots", "evidence_chains", "recommendations")
PACK_SECTIONS = ("schema_version", "artifact_type", "review", "source_quality_rules", "domain_hints", "analyzers", "output_hints", "limitations")


def write_tables(out: str, **relations: DataFrame) -> None:
    """Each relation whole, as Parquet; nothing of a repository is gathered into one document."""
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def write_documents(out: str, name: str, documents: DataFrame, column: str) -> None:
    """A document or report of each repository, as text in a folder of its own."""
    documents.select("repo", F.col(column).alias("value")).write.mode("overwrite").partitionBy("repo").text(f"{out}/{name}")


def folder_of(repo: str) -> str:
    """A repository's name as the name of one folder."""
    name = quote(repo, safe=" @+,=")
    return name.replace(".", "%2E") if not name.strip(".") else name


class NamedFileWriter(DataSourceWriter):
    """Writes each row's text as one file. It is whole when it gets its name, so a task that fails or runs again leaves no
    half file; the parts of a task that was lost meanwhile go when the write ends."""

    def __init__(self, options: dict[str, str]):
        self.path, self.name, self.mark = options["path"], options["name"], options["mark"]

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        for repo, text in rows:
            folder = os.path.join(self.path, folder_of(repo))
            os.makedirs(folder, exist_ok=True)
            part = os.path.join(folder, f".{self.mark}-{uuid.uuid4().hex}")
            try:
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(text or "")
                os.replace(part, os.path.join(folder, self.name))
            except BaseException:
                if os.path.exists(part):
                    os.remove(part)
                raise
        return WriterCommitMessage()

    def swept(self) -> None:
        for folder in os.listdir(self.path) if os.path.isdir(self.path) else ():
            own = os.path.join(self.path, folder)
            for name in os.listdir(own) if os.path.isdir(own) else ():
                if name.startswith(f".{self.mark}-"):
                    os.remove(os.path.join(own, name))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.swept()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.swept()


class NamedFiles(DataSource):
    """Format ``named_files``; options: path, name and mark (that of unfinished parts)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "repo string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return NamedFileWriter(self.options)


def write_named(out: str, name: str, documents: DataFrame, column: str) -> None:
    """OUT/<repo>/<name> of each repository, in a folder that driver and executors see; write_documents takes any store."""
    spark = documents.sparkSession
    spark.dataSource.register(NamedFiles)
    rows = documents.select("repo", F.col(column).alias("value")).where("repo is not null")
    rows.write.format("named_files").option("path", os.path.abspath(out)).option("name", name).option("mark", uuid.uuid4().hex).mode("append").save()


def missing_sections(documents: DataFrame, column: str, required: tuple[str, ...]) -> DataFrame:
    """repo, missing (array): sections that a document should have and hasn't; a section without rows has no key."""
    absent = F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")))
    return documents.select("repo", absent.alias("missing")).where(F.size("missing") > 0)


def console_summary(findings: DataFrame, paths: DataFrame, n: int = 50) -> DataFrame:
    """repo, place, line: findings by severity and title, then attack paths."""
    found = first_rows(findings, ["repo"], [*threats.finding_order(), "rule"], n)
    lines = found.select("repo", F.col("rn").alias("place"), F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title").alias("line"))
    return lines.union(paths.select("repo", F.col("place") + n, F.concat(F.lit("path: "), "name")))


def console_lines(found: Result, findings: DataFrame, paths: DataFrame, most: int = 200) -> Iterator[str]:
    """What a console shows: totals of all repositories, then the first lines of the summary by repository."""
    scan = found.scan
    files = found.meta.agg(F.count("*").alias("n"), F.sum("files_scanned").alias("files")).first()
    languages = [r[0] for r in found.meta.select(F.explode("languages").alias("l")).distinct().orderBy("l").collect()]  # a few
    yield f"Repositories: {files.n}; files scanned: {files.files or 0}; languages: {', '.join(languages) or 'none'}"
    for name, df in (("Routes", scan.route), ("External calls", scan.external_call), ("Datastores", scan.database_hint)):
        yield f"{name}: {df.count()}"
    shown = console_summary(findings, paths).orderBy("repo", "place").limit(most + 1).collect()
    for r in shown[:most]:
        yield f"{r.repo}: {r.line}"
    if len(shown) > most:
        yield "... and more; the table `summary` has all"
