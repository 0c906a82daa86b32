"""Attack surfaces: one row for each route, classified by path, hints and what the repository reaches.

A surface's auth signals are those of its file, else all of its repository's, so many surfaces share one set. ``classified``
names the set (``own_auth``: the file's or the repository's) and says of it what rules ask; its rows don't grow with the
hints of a repository. ``expanded`` puts the signals and what is told of them to the rows that are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.expressions import first_rows, has_any, location, rank_of, sorted_set
from factloom.operators.signals import family
from factloom.sources.adapters import FAMILIES, Scan
from factloom.sources.staged import numbered

# Path parts by category, in the order in which they are tried.
CATEGORIES = (
    ("webhook", ("webhook",)),
    ("admin", ("/admin", "/manage", "/root")),
    ("auth", ("/login", "/signin", "/signup", "/auth", "/session", "/token", "/oauth")),
    ("upload", ("/upload", "/import", "/file")),
    ("internal", ("/internal", "/debug")),
    ("health", ("/health", "/ready", "/live", "/metrics")),
)
# Hints of handlers that face inward.
INTERNAL_HANDLERS = ("handler_visibility:internal", "handler_type:internal_handler", "service_role:worker", "service_role:event_consumer", "service_role:internal_handler")
# Auth hints that show who sends a webhook.
TRUSTED = ("jwt", "oauth", "authorization", "service_auth")
WHY = {
    "webhook": "Webhooks take events from anyone on the internet.",
    "admin": "Administrative routes give access to privileged actions.",
    "auth": "Authentication routes invite guessing, token abuse and session attacks.",
    "upload": "Uploads and imports hand untrusted files to parsers.",
    "internal": "Internal and debug routes are dangerous once they can be reached from outside.",
    "health": "Operational routes expose little, but help reconnaissance.",
    "public_api": "Public routes are where probing for weak input handling begins.",
}


def category_of(path: Column) -> Column:
    low, out = F.lower(path), F.lit("public_api")
    for name, parts in reversed(CATEGORIES):
        out = F.when(has_any(low, parts), name).otherwise(out)
    return out


def flags(scan: Scan) -> DataFrame:
    """repo, has_db, has_call: one row for each repository with either."""
    db, call = (df.select("repo").distinct() for df in (scan.database_hint, scan.external_call))
    return db.withColumn("has_db", F.lit(True)).join(call.withColumn("has_call", F.lit(True)), "repo", "full").na.fill(False)


def attributed(scan: Scan, names: tuple[str, ...], column: str, rows: DataFrame | None = None) -> DataFrame:
    """rows (the scan's routes) with the sorted hints of the families in their file, else in all of the repository."""
    hints = family(scan, *names).select("repo", "file", "hint")
    here = hints.groupBy("repo", "file").agg(sorted_set("hint").alias("_here"))
    anywhere = hints.groupBy("repo").agg(sorted_set("hint").alias("_repo"))
    joined = (scan.route if rows is None else rows).join(here, ["repo", "file"], "left").join(anywhere, "repo", "left")
    return joined.withColumn(column, F.coalesce("_here", "_repo", F.array().cast("array<string>"))).drop("_here", "_repo")


#: What is said of a set of auth signals: whether there are any, whether one shows who sends, whether one is of a protocol.
SAID = ("guarded", "trusted", "protocol_auth")


def said_of(hint: Column) -> list[Column]:
    return [hint.isNotNull(), hint.isin(*TRUSTED), F.lower(hint).contains("atproto_")]


def marked(scan: Scan, routes: DataFrame) -> DataFrame:
    """routes with own_auth (whether their file has auth hints) and flags of hints: faces_in and faces_out of the file's hints, else
    of the repository's; SAID of the file's auth hints, else of the repository's."""
    hint, auth = F.col("hint"), F.col("family") == "auth"
    faces = {"faces_in": hint.isin(*INTERNAL_HANDLERS), "faces_out": hint == "handler_visibility:public"}
    said = faces | {"auth": auth} | {k: auth & on for k, on in zip(SAID, said_of(hint), strict=True)}
    here = family(scan, *FAMILIES).groupBy("repo", "file").agg(*(F.bool_or(on).alias(f"{k}_here") for k, on in said.items()))
    anywhere = here.groupBy("repo").agg(*(F.bool_or(f"{k}_here").alias(f"{k}_repo") for k in said))
    rows = routes.join(here, ["repo", "file"], "left").join(anywhere, "repo", "left").withColumn("own_auth", F.coalesce("auth_here", F.lit(False)))
    of_set = {k: F.coalesce(F.when(F.col("own_auth"), F.col(f"{k}_here")).otherwise(F.col(f"{k}_repo")), F.lit(False)) for k in SAID}
    return rows.withColumns({k: F.coalesce(f"{k}_here", f"{k}_repo", F.lit(False)) for k in faces} | of_set)


def flagged(surfaces: DataFrame) -> DataFrame:
    """Surfaces that come with auth_signals alone, with SAID of them."""
    any_of = lambda i: F.exists("auth_signals", lambda h: F.coalesce(said_of(h)[i], F.lit(False)))
    return surfaces.withColumns({k: any_of(i) for i, k in enumerate(SAID)})


def expanded(surfaces: DataFrame, scan: Scan) -> DataFrame:
    """Surfaces of a scan with auth_signals and rationale; those that have them already as they are."""
    if "auth_signals" in surfaces.columns:
        return surfaces
    rows = attributed(scan, ("auth",), "auth_signals", surfaces)
    rationale = F.concat_ws(
        " ",
        F.create_map(*(F.lit(x) for kv in WHY.items() for x in kv))[category_of(F.col("route"))],
        F.when(F.col("inward"), "Handler metadata says that the route faces inward."),
        F.when(F.col("guarded"), F.concat(F.lit("Auth indicators: "), F.array_join("auth_signals", ", "), F.lit("."))).otherwise("No auth indicators near this route."),
        F.when(F.col("data_store"), "A datastore is used in the repository."),
        F.when(F.col("outbound"), "Outbound calls are made in the repository."),
    )
    return rows.withColumn("rationale", rationale)


def identify_attack_surfaces(scan: Scan) -> DataFrame:
    """The columns of classified, with auth_signals (sorted) and rationale."""
    return expanded(classified(scan), scan)


def classified(scan: Scan) -> DataFrame:
    """repo, route, method, file, line, category, exposure, risk, inward, own_auth, guarded, trusted, protocol_auth, data_store,
    outbound, seq: rows of a bounded size, whatever the repository's hints."""
    rows = marked(scan, scan.route.join(flags(scan), "repo", "left").na.fill(False, ["has_db", "has_call"]))
    first = category_of(F.col("path"))
    inward = F.col("faces_in") & ~F.col("faces_out") & ~first.isin("admin", "auth", "webhook")
    safe = F.col("guarded")
    risk = F.when(first.isin("webhook", "admin", "upload"), "high").when(first == "auth", F.when(safe, "medium").otherwise("high")).when(first == "internal", "medium").when(first == "health", "low").otherwise(F.when(F.col("has_db") | F.col("has_call"), "medium").otherwise("low"))
    category = F.when(inward & (first == "public_api"), "internal").otherwise(first)
    return rows.select(
        "repo",
        F.col("path").alias("route"),
        "method",
        "file",
        "line",
        category.alias("category"),
        F.when(inward | (first == "internal"), "internal").otherwise("public").alias("exposure"),
        F.when(inward, F.when(category == "health", "low").otherwise("medium")).otherwise(risk).alias("risk"),
        inward.alias("inward"),
        "own_auth",
        *SAID,
        F.col("has_db").alias("data_store"),
        F.col("has_call").alias("outbound"),
        "seq",
    )


def traits(surfaces: DataFrame) -> DataFrame:
    """Expanded surfaces with a one-line summary of auth, data store and outbound reach."""
    text = F.concat_ws(
        "; ",
        F.when(F.size("auth_signals") > 0, F.concat(F.lit("auth signals: "), F.array_join("auth_signals", ", "))).otherwise("no auth signals observed"),
        F.when(F.col("data_store"), "data store reachable"),
        F.when(F.col("outbound"), "external trust boundary"),
    )
    return surfaces.withColumn("traits", text)


RISKS = ("high", "medium", "low")


def surface_summary(surfaces: DataFrame, scan: Scan, n: int = 10) -> DataFrame:
    """repo, section, place, method, route, file, traits: the first n of four lists by risk, route and method."""
    sections = F.array_compact(
        F.array(
            F.when(F.col("risk") == "high", "highest_risk"),
            F.when(F.col("category").isin("auth", "admin"), "auth_and_admin"),
            F.when((F.col("exposure") == "public") & ~F.col("category").isin("auth", "admin", "health"), "public"),
            F.when(F.col("category").isin("health", "internal"), "operational"),
        )
    )
    rows = surfaces.withColumn("section", F.explode(sections))
    few = first_rows(rows, ["repo", "section"], [rank_of(F.col("risk"), RISKS), "route", "method", "seq"], n)
    return traits(expanded(few, scan)).select("repo", "section", F.col("rn").alias("place"), "method", "route", "file", "traits")


def surface_counts(surfaces: DataFrame) -> DataFrame:
    """The priority view of each repository."""
    return surfaces.groupBy("repo").agg(
        F.count_if(F.col("risk") == "high").alias("n_high"),
        F.count_if(F.col("exposure") == "public").alias("n_public"),
        F.count_if(F.col("exposure") == "internal").alias("n_internal"),
        F.count_if(F.col("data_store")).alias("n_data"),
        F.count_if(F.col("outbound")).alias("n_outbound"),
    )


def architecture_graph(scan: Scan) -> tuple[DataFrame, DataFrame]:
    """Nodes (repo, node, label) and edges (repo, source, target, relation) of each repository's system graph."""
    web = scan.route.select("repo").distinct()
    db = scan.database_hint.select("repo", "kind").distinct()
    calls = numbered(scan.external_call.select("repo", "target", "seq"), "seq", "n").select("repo", F.concat(F.lit("external_"), F.col("n")).alias("node"), F.col("target").alias("label"))
    nodes = scan.repo.select("repo", F.lit("repo").alias("node"), F.lit("repository").alias("label")).union(web.select("repo", F.lit("web"), F.lit("web_app"))).union(db.select("repo", F.concat(F.lit("db_"), F.col("kind")), "kind")).union(calls)
    edges = web.select("repo", F.lit("repo").alias("source"), F.lit("web").alias("target"), F.lit("contains").alias("relation"))
    edges = edges.union(db.select("repo", F.lit("repo"), F.concat(F.lit("db_"), F.col("kind")), F.lit("uses"))).union(calls.select("repo", F.lit("repo"), "node", F.lit("calls")))
    return nodes, edges


def architecture_summary(scan: Scan) -> DataFrame:
    """repo, n_routes, datastores, targets, auth, n_secrets, busiest: counts, sorted sets, three busiest route files."""
    text = lambda df, column, name: df.groupBy("repo").agg(F.array_join(sorted_set(column), ", ").alias(name))
    files = scan.route.groupBy("repo", "file").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    few = first_rows(files, ["repo"], [F.desc("n"), "seq"], 3)
    busiest = few.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "file", "n"))), lambda x: F.concat_ws(":", x["file"], x["n"].cast("string"))), ", ").alias("busiest"))
    counts = scan.repo.join(scan.route.groupBy("repo").agg(F.count("*").alias("n_routes")), "repo", "left").join(scan.secret_hint.groupBy("repo").agg(F.count("*").alias("n_secrets")), "repo", "left").na.fill(0)
    out = counts
    for df in (text(scan.database_hint, "kind", "datastores"), text(scan.external_call, "target", "targets"), text(family(scan, "auth"), "hint", "auth"), busiest):
        out = out.join(df, "repo", "left")
    return out.na.fill("none", ["datastores", "targets", "auth", "busiest"])


def surface_location(surfaces: DataFrame) -> Column:
    return location(F.col("file"), F.col("line"))
