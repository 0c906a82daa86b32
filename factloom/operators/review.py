"""Review views: evidence classes, linked surfaces, finding scores, and the rows and documents of the JSON review.

A repository's surfaces may be many, so they are never gathered: what a finding needs of them is counted in partial
aggregates, and lists are cut by row_number before they are collected. Findings (eleven at most a repository) and paths
(five at most) are small by rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.expressions import first_rows, has_any, location, low_quality, rank_of, sorted_set, top_text
from factloom.operators.chains import text
from factloom.operators.ranking import protocol_derived, summed, top_reasons
from factloom.operators.signals import family, scan_meta
from factloom.operators.surfaces import RISKS, expanded
from factloom.operators.threats import SEVERITIES, finding_order
from factloom.sources.adapters import Scan
from factloom.sources.staged import settled_together

CLASSES = ("observed_runtime_public", "observed_runtime_internal", "inferred_protocol", "inferred", "low_quality")
PATHS_MOST = 5
# Numbers of rows that a document shows.
SHOWN = {"weaknesses": 8, "hotspots": 6, "chains": 6, "recommendations": 8, "steps": 8, "surfaces": 60}
PROMPT_SHOWN = {"surfaces": 50, "findings": 30, "paths": 10}
SCHEMA_VERSION = "1.2.0"
PACK_VERSION = "1.0.0"

MITIGATIONS = {
    "webhook": "Verify signatures before a payload is read, refuse replays, and validate strictly before state changes.",
    "admin": "Authenticate strongly, authorize every admin action on the server, and expose admin routes less.",
    "upload": "Limit formats, isolate parsers, scan uploads, and distrust files until they are processed.",
    "auth_gap": "Check rate limits, credential validation, session handling, and where trust is established.",
    "integration": "Authenticate and sign outbound requests, and keep route input from steering third parties.",
    "secret_env": "Inject secrets securely, never log them, rotate them, and scope each to what its route needs.",
    "public_data": "Validate input first, authorize at the route, and keep queries and writes parameterized.",
    "atproto": "Authorize XRPC handlers by namespace, and validate service auth at each hop.",
    "service": "Check authentication and authorization at each service hop, and restrict callers.",
    "framework": "Authorize at the route boundary, and enforce policy in controllers before sinks.",
    "fallback": "Take this as a weak signal: add parsers, and validate entry points and trust boundaries by hand.",
}
SAID = {
    "auth": "Authentication or identity indicators were observed.",
    "internal": "Some entry points appear internal-only, which limits direct exposure.",
    "secret": "Secrets appear to come from the environment rather than from literals.",
    "none": "No strong defensive indicators were detected.",
}


def evidence_class() -> Column:
    """The first of low_quality, inferred_protocol, observed_runtime_public and _internal that fits, else inferred."""
    exposure = F.col("exposure")
    return F.when(low_quality(F.col("file")), "low_quality").when(protocol_derived(), "inferred_protocol").when(exposure == "public", "observed_runtime_public").when(exposure == "internal", "observed_runtime_internal").otherwise("inferred")


def counts_of_classes(cls: str = "class") -> list[Column]:
    return [F.count_if(F.col(cls) == k).alias(k) for k in CLASSES]


def evidence_counts(surfaces: DataFrame) -> DataFrame:
    """repo and a count for each class, zeros kept."""
    return surfaces.withColumn("class", evidence_class()).groupBy("repo").agg(*counts_of_classes())


def basis(prefix: str = "") -> Column:
    """The kind of evidence that half of the counted surfaces share, else mixed."""
    c = lambda k: F.coalesce(F.col(f"{prefix}{k}"), F.lit(0))
    total = F.greatest(reduce(lambda a, b: a + b, map(c, CLASSES)), F.lit(1))
    observed = c("observed_runtime_public") + c("observed_runtime_internal")
    return F.when(observed * 2 >= total, "observed").when(c("inferred_protocol") * 2 >= total, "inferred_protocol").when(c("low_quality") * 2 >= total, "low_quality").otherwise("mixed")


def claim() -> Column:
    """Title and evidence of a finding, lower-cased."""
    return F.lower(F.concat_ws(" ", "title", F.replace("evidence", F.lit(" | "), F.lit(" "))))


def related_surfaces(findings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """repo, rule, claim and the surfaces whose route, file or category the claim names."""
    claims = findings.select("repo", "rule", claim().alias("claim"))
    said = F.col("claim")
    return claims.join(surfaces, "repo").where(said.contains(F.lower("route")) | said.contains(F.lower("file")) | said.contains(F.lower("category")))


def numeric_confidence(value: Column) -> Column:
    """The number after "confidence=", else null."""
    return F.regexp_extract(F.lower(value), r"confidence=([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def path_text(i: int) -> Column:
    return F.lower(F.array_join(F.get("paths", F.lit(i))["steps"], " "))


def linked(findings: DataFrame, surfaces: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings with counts and maxima over their related surfaces (null without any), and routed: which of the
    repository's paths, by place, name a related surface's route."""
    few = first_rows(paths, ["repo"], ["place"], PATHS_MOST).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("place", "name", "steps"))).alias("paths"))
    c = F.col
    rows = related_surfaces(findings, surfaces).join(few, "repo", "left").withColumn("class", evidence_class())
    named = [F.bool_or((c("route") != "") & path_text(i).contains(F.lower("route"))).alias(f"routed{i}") for i in range(PATHS_MOST)]
    reach = F.when(c("data_store"), 2.0).otherwise(0.0) + F.when(c("outbound"), 2.0).otherwise(0.0)
    privilege = F.when(c("category").isin("admin", "auth"), 3.0).when(c("category").isin("webhook", "upload"), 2.0).otherwise(1.0)
    stats = rows.groupBy("repo", "rule").agg(F.count("*").alias("n_related"), F.bool_or(c("exposure") == "public").alias("any_public"), F.max(privilege).alias("privilege"), F.max(reach).alias("reach"), *counts_of_classes(), *named)
    return findings.withColumn("claim", claim()).join(stats, ["repo", "rule"], "left").join(few, "repo", "left").withColumn("n_related", F.coalesce("n_related", F.lit(0)))


def path_related(i: int) -> Column:
    """Whether path i's name, or one of its first two steps, is in the claim, or it names a related surface's route."""
    p = F.get("paths", F.lit(i))
    said = F.col("claim").contains(F.lower(p["name"])) | F.exists(F.slice(p["steps"], 1, 2), lambda s: F.col("claim").contains(F.lower(s))) | F.coalesce(F.col(f"routed{i}"), F.lit(False))
    return p.isNotNull() & said


def related_paths(findings: DataFrame, surfaces: DataFrame, paths: DataFrame) -> DataFrame:
    """repo, rule, place, name of the paths that belong to a finding."""
    each = F.array_compact(F.array(*(F.when(path_related(i), F.get("paths", F.lit(i))) for i in range(PATHS_MOST))))
    return linked(findings, surfaces, paths).select("repo", "rule", F.explode(each).alias("p")).select("repo", "rule", "p.place", "p.name")


def finding_scores(findings: DataFrame, surfaces: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings with score, reasons (the three greatest factors) and basis of their related surfaces."""
    c, zero = F.col, F.lit(0.0)
    n = c("n_related")
    public = F.coalesce("any_public", F.lit(False))
    bold = has_any(F.lower("title"), ("privilege", "admin", "auth", "token", "identity"))
    privilege = F.greatest(F.coalesce("privilege", F.lit(1.0)), F.when(bold, F.lit(2.5)).otherwise(zero))
    depth = F.coalesce(F.greatest(F.lit(None).cast("double"), *(F.when(path_related(i), F.least(F.size(F.get("paths", F.lit(i))["steps"]), F.lit(8)) / 2.0) for i in range(PATHS_MOST))), F.lit(0.5))
    known = F.array_max(F.transform(F.split("evidence", r" \| "), numeric_confidence))
    sure = F.when(c("confidence") == "high", 3.0).when(c("confidence") == "medium", 2.0).otherwise(1.0) + F.coalesce(known, zero)
    k = lambda name: F.coalesce(name, F.lit(0)).cast("double")
    quality = k("observed_runtime_public") * 1.5 - k("inferred_protocol") * 0.5 - k("low_quality") * 3.0
    weak = low_quality(F.concat_ws(" ", "title", F.replace("evidence", F.lit(" | "), F.lit(" ")))) & (k("low_quality") == n)
    factors = {
        "exposure": F.when(public, 6.0).otherwise(2.0),
        "privilege": privilege * 2.0,
        "reachability": F.when(public, 3.0).otherwise(1.5),
        "trust_boundary": F.coalesce("reach", F.lit(1.0)) * 2.0,
        "chain_depth": depth * 1.2,
        "confidence": sure * 1.5,
        "evidence_linkage": F.when(n == 0, -8.0).otherwise(F.least(F.lit(2.0), n * 0.5)),
        "source_quality": quality,
        "source_quality_penalty": F.when(weak, -10.0).otherwise(0.0),
    }
    listed, total = summed(factors)
    rows = linked(findings, surfaces, paths).withColumn("factors", listed)
    return rows.select(*findings.columns, total.alias("score"), top_reasons(c("factors"), 3).alias("reasons"), "n_related")


def ordered(findings: DataFrame, n: int) -> DataFrame:
    return first_rows(findings, ["repo"], [*finding_order(), "rule"], n)


def with_basis(findings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Findings with the basis of their related surfaces; of all the repository's surfaces, if none is related."""
    related = related_surfaces(findings, surfaces).withColumn("class", evidence_class()).groupBy("repo", "rule").agg(*counts_of_classes())
    every = evidence_counts(surfaces).select("repo", *(F.col(k).alias(f"all_{k}") for k in CLASSES))
    rows = findings.join(related, ["repo", "rule"], "left").join(every, "repo", "left")
    return rows.select(*findings.columns, F.when(F.col("low_quality").isNull(), basis("all_")).otherwise(basis()).alias("basis"))


def mitigation() -> Column:
    return F.create_map(*(F.lit(x) for kv in MITIGATIONS.items() for x in kv))[F.col("rule")]


def weaknesses(findings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """repo, place, title, severity, confidence, basis, evidence, mitigation of the first findings."""
    rows = with_basis(ordered(findings, SHOWN["weaknesses"]), surfaces)
    return rows.select("repo", F.col("rn").alias("place"), "title", "severity", "confidence", "basis", "evidence", mitigation().alias("mitigation"))


def hotspots(surfaces: DataFrame) -> DataFrame:
    """repo, place, method, route, file, category, risk, exposure, class; tests and examples only if there is no else."""
    order = ["low", rank_of(F.col("risk"), RISKS), F.col("exposure") != "public", "route", "seq"]
    top = first_rows(surfaces.withColumn("low", low_quality(F.col("file"))), ["repo"], order, SHOWN["hotspots"])
    top = top.withColumn("best", F.min("low").over(Window.partitionBy("repo"))).where(F.col("low") == F.col("best"))
    return top.select("repo", F.col("rn").alias("place"), "method", "route", "file", "category", "risk", "exposure", evidence_class().alias("class"))


def evidence_chains(paths: DataFrame) -> DataFrame:
    """repo, place, name, basis, steps (array) of the first paths."""
    said = F.lower(F.array_join("steps", " "))
    entry = said.contains("entry:")
    kind = F.when(entry & said.contains("confidence="), "observed_plus_inferred").when(entry, "observed").otherwise("inferred")
    return paths.where(F.col("place") <= SHOWN["chains"]).select("repo", "place", "name", kind.alias("basis"), F.slice("steps", 1, SHOWN["steps"]).alias("steps"))


def recommendations(findings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """repo, place, priority, basis, action, finding: the first finding of each mitigation."""
    acts = findings.withColumn("action", mitigation()).where("action <> ''")
    one = first_rows(acts, ["repo", "action"], [*finding_order(), "rule"]).drop("rn")
    rows = with_basis(ordered(one, SHOWN["recommendations"]), surfaces)
    return rows.select("repo", F.col("rn").alias("place"), F.col("severity").alias("priority"), "basis", "action", F.col("title").alias("finding"))


def strengths(scan: Scan, surfaces: DataFrame) -> DataFrame:
    """repo, place, statement, basis, evidence (joined by " | "); one row at least for each repository."""
    c = F.col
    hints = family(scan, "auth").select("repo", "hint").distinct()
    places = surfaces.where(c("exposure") == "internal")
    line = text(c("method"), " ", c("route"), " (", location(c("file"), c("line")), ")")
    parts = {
        "auth": (1, "observed", top_text(hints, ["repo"], ["hint"], c("hint"), 8, "evidence")),
        "internal": (2, "inferred", top_text(places, ["repo"], ["seq"], line, 6, "evidence")),
        "secret": (3, "observed", top_text(scan.secret_hint, ["repo"], ["seq"], text(c("name"), " (", c("file"), ")"), 8, "evidence")),
    }
    rows = reduce(DataFrame.union, (df.select("repo", F.lit(i).alias("place"), F.lit(SAID[k]).alias("statement"), F.lit(b).alias("basis"), "evidence") for k, (i, b, df) in parts.items()))
    none = scan.repo.join(rows.select("repo").distinct(), "repo", "left_anti").select("repo", F.lit(1), F.lit(SAID["none"]), F.lit("inferred"), F.lit(""))
    return rows.union(none)


# Marks of a domain in routes, files and auth hints.
ATPROTO_MARKS = ("/xrpc/", "atproto_", "com.atproto.")
BLUESKY_MARKS = ("app.bsky.",)
LAMINAS_MARKS = ("laminas", "module.config.php")


def domain_hints(scan: Scan) -> DataFrame:
    """repo and its sorted domain tags (array): any of atproto, bluesky, laminas, else general."""
    words = scan.route.select("repo", F.lower(F.concat_ws(" ", "path", "file")).alias("w")).union(family(scan, "auth").select("repo", F.lower("hint")))
    said = lambda marks: F.coalesce(F.bool_or(has_any(F.col("w"), marks)), F.lit(False))
    flags = words.groupBy("repo").agg(said(ATPROTO_MARKS + BLUESKY_MARKS).alias("atproto"), said(BLUESKY_MARKS).alias("bluesky"), said(LAMINAS_MARKS).alias("laminas"))
    tags = F.array_compact(F.array(*(F.when(F.col(k), k) for k in ("atproto", "bluesky", "laminas"))))
    rows = scan.repo.join(flags, "repo", "left")
    return rows.select("repo", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("general"))).alias("tags"))


def repo_context(scan: Scan) -> DataFrame:
    """repo, context: a line of numbers for prompts."""
    counts = [df.groupBy("repo").agg(F.count("*").alias(k)) for k, df in (("routes", scan.route), ("external_calls", scan.external_call), ("auth_hints", family(scan, "auth")), ("secret_hints", scan.secret_hint))]
    kinds = scan.database_hint.groupBy("repo").agg(F.array_join(sorted_set("kind"), ", ").alias("datastores"))
    rows = reduce(lambda a, b: a.join(b, "repo", "left"), counts, scan.repo.join(scan_meta(scan).select("repo", F.col("n_files").alias("files_scanned")), "repo", "left").join(kinds, "repo", "left"))
    n = lambda k: F.concat(F.lit(f"{k}="), F.coalesce(F.col(k), F.lit(0)).cast("string"))
    stores = F.concat(F.lit("datastores="), F.coalesce("datastores", F.lit("none")))
    return rows.select("repo", F.concat_ws("; ", F.concat(F.lit("root="), "repo"), n("files_scanned"), n("routes"), n("external_calls"), stores, n("auth_hints"), n("secret_hints")).alias("context"))


def prompt_counts(surfaces: DataFrame) -> DataFrame:
    """Counts of classes among the surfaces that a prompt shows."""
    return evidence_counts(first_rows(surfaces, ["repo"], ["seq"], PROMPT_SHOWN["surfaces"])).drop("inferred")


def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """The rows of a cut relation as one array for each repository, in order of place; keys are sorted by name."""
    return df.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", *columns))), lambda x: F.struct(*(x[k].alias(k) for k in sorted(columns)))).alias(name))


def shown_surfaces(surfaces: DataFrame, scan: Scan, n: int) -> DataFrame:
    rows = expanded(first_rows(surfaces, ["repo"], ["seq"], n), scan)
    return rows.withColumns({"place": F.col("rn"), "evidence_class": evidence_class()})


def beside(context: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """context with the columns of the parts, each a row for a repository. They are written by themselves: in one plan, a
    single task would hold the sorts and joins of all of them at once."""
    held = settled_together({"context": context} | {p.columns[-1]: p for p in parts})
    return reduce(lambda a, b: a.join(b, "repo", "left"), held.values())


def review_json(scan: Scan, surfaces: DataFrame, findings: DataFrame, paths: DataFrame) -> DataFrame:
    """repo, review: the JSON review of each repository. It shows cut lists only; whole relations are written as tables."""
    parts = [
        evidence_counts(surfaces).select("repo", F.struct(*CLASSES).alias("evidence_class_counts")),
        listed(shown_surfaces(surfaces, scan, SHOWN["surfaces"]), "surfaces", "method", "route", "file", "line", "category", "exposure", "risk", "evidence_class", "auth_signals", "data_store", "outbound"),
        listed(strengths(scan, surfaces), "strengths", "statement", "basis", "evidence"),
        listed(weaknesses(findings, surfaces), "weaknesses", "title", "severity", "confidence", "basis", "evidence", "mitigation"),
        listed(hotspots(surfaces), "risk_hotspots", "method", "route", "file", "category", "risk", "exposure", "class"),
        listed(evidence_chains(paths), "evidence_chains", "name", "basis", "steps"),
        listed(recommendations(findings, surfaces), "recommendations", "priority", "basis", "action", "finding"),
    ]
    rows = beside(repo_context(scan), parts)
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("repo").alias("root"), F.col("context").alias("system_overview"), *(c for p in parts for c in p.columns if c != "repo"))
    return rows.select("repo", F.to_json(body).alias("review"))


#: What a pack says besides its review: how weak evidence is to be taken, for whom and how to write, and what to bear in mind.
QUALITY_RULES = {
    "default": "Rank weak signals down when you sort and prioritize.",
    "reporting": "Keep weak signals among the evidence, with their class.",
    "operator_note": "What rests on weak evidence alone isn't exposure in production until something else confirms it.",
}
OUTPUT_HINTS = {
    "audience": "security engineers, software engineers, tech leads",
    "style": "defensive, concrete and plain; evidence first, and open about what isn't certain; nothing invented, no help for attacks",
    "prioritization": "paths and trust boundaries of the highest impact and confidence first",
}
LIMITATIONS = ("Domain tags are inferred from routes, hints and file names.", "The analyzers named are those that were to run.")


def texts(of: dict[str, str]) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in sorted(of.items())))


def context_pack(scan: Scan, reviews: DataFrame, analyzers: DataFrame | None = None) -> DataFrame:
    """repo, pack: a review with domain tags, the analyzers that ran (name and more), and how evidence is to be weighed."""
    parts = ("/tests/", "/__tests__/", "/fixtures/", "/mocks/", "/examples/")
    rules = F.struct(texts(QUALITY_RULES).alias("handling"), F.array(*map(F.lit, parts)).alias("low_quality_path_segments"))
    ran = "array()"
    if analyzers is not None:
        rows = [r.asDict() for r in analyzers.select("name", "version", "languages", "targets").collect()]  # a row for each analyzer
        ran = "array(" + ", ".join(f"named_struct('languages', '{','.join(r['languages'])}', 'name', '{r['name']}', 'targets', '{','.join(r['targets'])}', 'version', '{r['version']}')" for r in rows) + ")"
    body = F.struct(
        F.expr(ran).alias("analyzers"),
        F.lit("review_context_pack").alias("artifact_type"),
        F.col("tags").alias("domain_hints"),
        F.array(*map(F.lit, LIMITATIONS)).alias("limitations"),
        texts(OUTPUT_HINTS).alias("output_hints"),
        F.parse_json("review").alias("review"),
        F.lit(PACK_VERSION).alias("schema_version"),
        rules.alias("source_quality_rules"),
    )
    return domain_hints(scan).join(reviews, "repo").select("repo", F.to_json(body).alias("pack"))


def evidence_pack(scan: Scan, surfaces: DataFrame, findings: DataFrame, paths: DataFrame) -> DataFrame:
    """repo, context, evidence (JSON): what a prompt shows, each row with an id by its place (surface:1 ...)."""
    ident = lambda k: F.concat(F.lit(f"{k}:"), F.col("place").cast("string"))
    found = ordered(findings, PROMPT_SHOWN["findings"]).withColumns({"place": F.col("rn"), "mitigation": mitigation()})
    ways = paths.where(F.col("place") <= PROMPT_SHOWN["paths"]).withColumn("steps", F.slice("steps", 1, SHOWN["steps"]))
    parts = [
        listed(ways.withColumn("id", ident("path")), "attack_paths", "id", "name", "steps"),
        listed(
            shown_surfaces(surfaces, scan, PROMPT_SHOWN["surfaces"]).withColumn("id", ident("surface")),
            "attack_surfaces",
            "id",
            "method",
            "route",
            "file",
            "category",
            "exposure",
            "risk",
            "evidence_class",
            "auth_signals",
            "data_store",
            "outbound",
        ),
        prompt_counts(surfaces).select("repo", F.struct(*sorted(k for k in CLASSES if k != "inferred")).alias("evidence_counts")),
        listed(found.withColumn("id", ident("finding")), "findings", "id", "title", "severity", "confidence", "evidence", "mitigation"),
    ]
    rows = beside(repo_context(scan), parts)
    return rows.select("repo", "context", F.to_json(F.struct(*(c for p in parts for c in p.columns if c != "repo"))).alias("evidence"))


SYSTEM = "You review source code defensively. Rest every claim on the evidence below, cite its ids, and tell what was observed from what is inferred. Invent nothing."


def prompts(pack: DataFrame) -> DataFrame:
    """repo, system, user of an evidence pack."""
    user = F.concat(F.lit("Repository: "), "context", F.lit("\n\nEvidence:\n"), "evidence")
    return pack.select("repo", F.lit(SYSTEM).alias("system"), user.alias("user"))
