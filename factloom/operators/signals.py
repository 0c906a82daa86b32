"""Merging signals: first seen by key, one stream of all families, hints by prefix, edges, and the auth filter."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.expressions import first_rows, location, service_from_path, starts_with_any
from factloom.sources.adapters import FAMILIES, Scan

@dataclass(frozen=True)
class MergeRule:
    """A family of a scan, and the columns by which its rows are one."""

    attr: str
    keys: tuple[str, ...]

    def __post_init__(self) -> None:
        if not all(x.isidentifier() for x in (self.attr, *self.keys)):
            raise ValueError(f"{self.attr!r} by {self.keys!r}: names of families and columns must be identifiers")


MERGE = (
    MergeRule("route", ("path", "method", "file")),
    MergeRule("external_call", ("target", "file")),
    MergeRule("database_hint", ("kind", "file")),
    MergeRule("hint", ("family", "hint", "file")),
    MergeRule("secret_hint", ("name", "file")),
)
#: Keys by which the rows of a family are one.
KEYS = {r.attr: list(r.keys) for r in MERGE}

# Hints that are kept among auth hints but say nothing of auth.
NOT_AUTH = (
    "service_name:",
    "service_role:",
    "entrypoint:",
    "edge:",
    "handler_type:",
    "handler_visibility:",
    "handler_visibility_basis:",
    "controller:",
    "service:",
    "omeka_",
    "laminas_",
    "atproto_namespace:",
    "atproto_namespace_ref:",
    "atproto_xrpc_ref:",
    "atproto_lexicon:",
    "atproto_event_stream:",
    "atproto_service_note:",
    "atproto_service_edge:",
    "atproto_repo:",
)
AUTH_WORDS = "auth|jwt|oauth|token|session|password|bearer|authorization|mfa|passport|login_required"


def first_seen(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key in the order of seq; an aggregate, so partial before the shuffle."""
    rest = [c for c in df.columns if c not in ("repo", *keys)]
    return df.groupBy("repo", *keys).agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("repo", *keys, "r.*").select(*df.columns)


def merged(scan: Scan) -> Scan:
    """Every family with one row for each key."""
    return Scan(scan.repo, *(first_seen(getattr(scan, t), KEYS[t]) for t in ("route", "external_call", "database_hint", "hint", "secret_hint")))


@dataclass(frozen=True)
class Result:
    """What one analyzer found: a scan, and meta (repo, languages, files_scanned)."""

    scan: Scan
    meta: DataFrame


def in_turn(scans: list[Scan], attr: str) -> DataFrame:
    """A family's rows of all scans, one below the other; seq is the scan's place, then the row's own."""
    rows = [getattr(s, attr).withColumn("seq", F.struct(F.lit(i).alias("turn"), F.col("seq").alias("own"))) for i, s in enumerate(scans)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def merge_results(results: list[Result], repos: DataFrame) -> Result:
    """The results as one: rows first seen by key, languages together and sorted, files summed. Every repository of repos is
    in it, with an empty result if there is none at all."""
    if not results:
        none = repos.select("repo", F.array().cast("array<string>").alias("languages"), F.lit(0).cast("long").alias("files_scanned"))
        empty = {"route": "path string, method string", "external_call": "target string", "database_hint": "kind string", "hint": "family string, hint string", "secret_hint": "name string"}
        more = {"hint": ", confidence double", "secret_hint": ", confidence double"}
        spark = repos.sparkSession
        parts = {k: spark.createDataFrame([], f"repo string, {v}, file string, line int{more.get(k, '')}, seq long") for k, v in empty.items()}
        return Result(Scan(repos, **parts), none)
    scans = [r.scan for r in results]
    merged_parts = {rule.attr: first_seen(in_turn(scans, rule.attr), list(rule.keys)) for rule in MERGE}
    meta = reduce(DataFrame.unionByName, [r.meta.select("repo", "languages", "files_scanned") for r in results])
    total = meta.groupBy("repo").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("languages")))).alias("languages"), F.sum("files_scanned").alias("files_scanned"))
    every = repos.join(total, "repo", "left")
    known = every.select("repo", F.coalesce("languages", F.array().cast("array<string>")).alias("languages"), F.coalesce("files_scanned", F.lit(0).cast("long")).alias("files_scanned"))
    return Result(Scan(repos, **merged_parts), known)


def file_signals(scans: list[Scan]) -> Scan:
    """Scans of single files put together: datastores and auth hints first seen by key, the other families as they are."""
    parts = {r.attr: in_turn(scans, r.attr) for r in MERGE}
    once = {attr: first_seen(parts[attr], KEYS[attr]) for attr in ("database_hint", "hint")}
    repos = reduce(DataFrame.union, [s.repo for s in scans]).distinct()
    return Scan(repos, **parts | once)


def with_earlier(df: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose key earlier doesn't have, first seen."""
    return first_seen(df, keys).join(earlier.select("repo", *keys).distinct(), ["repo", *keys], "left_anti")


def family(scan: Scan, *names: str) -> DataFrame:
    return scan.hint.where(F.col("family").isin(*names))


def is_auth_signal(hint: Column) -> Column:
    low = F.lower(hint)
    return F.when(low.startswith("atproto_auth:"), True).when(starts_with_any(low, NOT_AUTH), False).otherwise(low.rlike(AUTH_WORDS))


def auth_filtered(scan: Scan) -> Scan:
    """The scan with only those auth hints that speak of auth and that no other family has for the file, without lines."""
    auth = family(scan, "auth").where(is_auth_signal(F.col("hint")))
    rest = scan.hint.where("family <> 'auth'")
    kept = auth.join(rest.select("repo", "hint", "file").distinct(), ["repo", "hint", "file"], "left_anti").select(*scan.hint.columns)
    return scan.with_hints(kept.withColumns({"line": F.lit(None).cast("int"), "confidence": F.lit(0.7)}).unionByName(rest))


def all_signals(scan: Scan) -> DataFrame:
    """repo, kind, label, file, line, confidence, method, path, db_kind, place, evidence (null where a scan has none), seq: all
    families, one below the other."""
    none, sure = F.lit(None).cast("string"), F.lit(0.7)

    def part(df: DataFrame, kind: Column, label: Column, confidence: Column = sure, method: Column = none, path: Column = none, db: Column = none) -> DataFrame:
        return df.select(
            "repo",
            kind.alias("kind"),
            label.alias("label"),
            "file",
            "line",
            confidence.cast("double").alias("confidence"),
            method.alias("method"),
            path.alias("path"),
            db.alias("db_kind"),
            location(F.col("file"), F.col("line")).alias("place"),
            (F.col("evidence") if "evidence" in df.columns else none).alias("evidence"),
            "seq",
        )

    c = F.col
    return (
        part(scan.route, F.lit("route"), F.concat_ws(" ", "method", "path"), method=c("method"), path=c("path"))
        .unionByName(part(scan.external_call, F.lit("external_call"), c("target")))
        .unionByName(part(scan.database_hint, F.lit("database"), c("kind"), db=c("kind")))
        .unionByName(part(scan.hint, c("family"), c("hint"), c("confidence")))
        .unionByName(part(scan.secret_hint, F.lit("secret"), c("name"), c("confidence")))
    )


#: Family that holds the hints of a prefix besides the auth hints.
PREFIX_FAMILY = (
    ("service_", "service"),
    ("edge:", "edge"),
    ("entrypoint:", "entrypoint"),
    ("atproto_", "protocol"),
    ("protocol:", "protocol"),
    ("controller:", "framework"),
    ("service:", "framework"),
    ("omeka_", "framework"),
    ("laminas_", "framework"),
)


def prefixed_hints(scan: Scan, prefix: str) -> DataFrame:
    """repo, value, file, ord, seq of hints with a prefix, first seen: auth hints, then those of the prefix's family."""
    other = next((f for p, f in PREFIX_FAMILY if prefix.startswith(p)), None)
    found = scan.hint.where(F.col("hint").startswith(prefix) & F.col("family").isin(*filter(None, ("auth", other))))
    rows = found.select("repo", F.substring(F.col("hint"), F.lit(len(prefix) + 1), F.length("hint")).alias("value"), "file", F.when(F.col("family") == "auth", 0).otherwise(1).alias("ord"), "seq")
    return rows.groupBy("repo", "value", "file").agg(F.min(F.struct("ord", "seq")).alias("o")).select("repo", "value", "file", "o.ord", "o.seq")


def edge_hints(scan: Scan) -> DataFrame:
    """repo, source, target, file, ord, seq of service edges: edge hints, then auth hints."""
    raw = F.substring(F.col("hint"), F.lit(6), F.length("hint"))
    clean = lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = family(scan, "edge", "auth").where(F.col("hint").startswith("edge:") & raw.contains("->"))
    source = F.substring_index(raw, "->", 1)
    target = F.substring(raw, F.length(source) + 3, F.length(raw))
    return rows.select(
        "repo",
        clean(source).alias("source"),
        clean(target).alias("target"),
        "file",
        F.when(F.col("family") == "edge", 0).otherwise(1).alias("ord"),
        "seq",
    ).where("source <> '' and target <> ''")


def file_services(scan: Scan, notes: bool = False) -> DataFrame:
    """repo, file, service, explicit: named by the last service_name hint of the file, else by its path (else, with
    notes, by the first protocol note)."""
    named = prefixed_hints(scan, "service_name:").groupBy("repo", "file").agg(F.max_by(F.lower("value"), F.struct("ord", "seq")).alias("service"))
    files = named.select("repo", "file").union(scan.route.select("repo", "file")).union(scan.database_hint.select("repo", "file")).union(scan.external_call.select("repo", "file")).distinct()
    out = files.join(named, ["repo", "file"], "left").withColumn("service", F.coalesce("service", service_from_path(F.col("file"))))
    if notes:
        note = prefixed_hints(scan, "atproto_service_note:").groupBy("repo", "file").agg(F.min_by(F.lower("value"), F.struct("ord", "seq")).alias("note"))
        out = out.join(note, ["repo", "file"], "full").withColumn("service", F.coalesce("service", "note")).drop("note")
    return out.where("service is not null")


def scan_meta(scan: Scan) -> DataFrame:
    """repo, n_routes, n_calls, n_databases, n_hints, n_secrets, n_files of every repository."""
    count = lambda df, name: df.groupBy("repo").agg(F.count("*").alias(name))
    parts = {"n_routes": scan.route, "n_calls": scan.external_call, "n_databases": scan.database_hint, "n_hints": scan.hint, "n_secrets": scan.secret_hint}
    files = scan.route.select("repo", "file").union(scan.external_call.select("repo", "file")).union(scan.database_hint.select("repo", "file")).union(scan.hint.select("repo", "file")).union(scan.secret_hint.select("repo", "file"))
    out = scan.repo.join(files.groupBy("repo").agg(F.count_distinct("file").alias("n_files")), "repo", "left")
    for name, df in parts.items():
        out = out.join(count(df, name), "repo", "left")
    return out.fillna(0, [*parts, "n_files"])
