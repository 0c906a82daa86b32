"""Insights that cut across a repository's signals: eleven rules over secrets, surfaces, paths, assets and controls.

An insight is (repo, id, kind, title, narrative, severity, confidence, evidence, assets, controls, routes, action); evidence
is joined by " | ", the related ids and routes are arrays. Titles, narratives and actions are templates of our own
(``TEXTS``), whose names in braces are filled per row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.expressions import first_rows, first_values, has_any, location, low_quality_ext, module_of, rank_of, sorted_set, wrapped
from factloom.operators.chains import text
from factloom.operators.protection import CRITICALITY, STATE_CHANGING, sensitive, union
from factloom.sources.adapters import Scan

# Control kinds expected by asset kind.
EXPECTED = {
    "credentials": ("authentication", "encryption_at_rest", "audit_logging"),
    "session": ("authentication", "rate_limiting", "encryption_in_transit"),
    "user_pii": ("authentication", "authorization", "audit_logging"),
    "payment": ("authentication", "authorization", "audit_logging", "encryption_at_rest"),
    "internal_secret": ("secret_management", "audit_logging"),
}
# Parts of routes and paths, and words of secret names, that the rules look for.
ADMIN_PARTS = (
    "/admin", "/manage", "/root", "/superuser", "/sudo", "/su/", "/role", "/roles", "/permission", "/permissions", "/grant", "/revoke",
    "/impersonate", "/owner", "/owners", "/membership",
)
BYPASS_PARTS = ("/webhook", "/callback", "/health", "/healthz", "/ping", "/metrics", "/internal", "/_internal", "/debug")
INTERNAL_PARTS = ("/internal/", "/private/", "/admin_internal/", "_internal_", "/intranet/")
BENIGN_PARTS = (
    "/health", "/healthz", "/ping", "/status", "/metrics", "/version", "/_static/", "/assets/", "/favicon", "/robots.txt", "/.well-known/",
    "/public/",
)
SECRET_WORDS = ("jwt", "session", "auth", "signing", "private", "master", "encryption", "stripe", "webhook")
AUTH_SECRET_WORDS = ("jwt", "session", "auth_secret", "signing", "cookie")
DATA_WORDS = ("database", "datastore", "data_store", "db:", "kind=")
ON_THE_WAY = ("authentication", "input_validation", "rate_limiting")
BYPASSED = ("authentication", "csrf_protection", "rate_limiting")
PROTECTED_KINDS = ("payment", "credentials", "user_pii")

#: Of each kind: title, narrative, suggested action.
TEXTS = {
    "shared_secret_blast_radius": (
        "Secret `{name}` is read by {modules} modules",
        "`{name}` is read in {modules} modules and {files} files. Whoever learns it has the trust of all of them, and it can be changed only in all of them at once.",
        "Give each service a secret of its own, or let one service verify on behalf of the others.",
    ),
    "sensitive_asset_reachability": (
        "{asset}: public routes without auth signals run beside it",
        "{asset} (criticality {criticality}) shares modules with {n} public route(s) that show no sign of authentication, so a stranger's request runs next to it without a guard.",
        "Guard these routes, or move their handlers out of the asset's modules.",
    ),
    "defense_gap_in_chain": (
        "Path `{path}` ends at data without {missing}",
        "`{path}` leads to a data store, and nothing in the repository shows {missing}. What enters at its first step can reach its last one unchecked.",
        "Put {missing} in front of the path's entry, or say in code where it is done.",
    ),
    "control_strength_mismatch": (
        "{asset} lacks expected controls: {gaps}",
        "With criticality {criticality}, {asset} would be expected to have {expected}. Not shown by any signal: {gaps}.",
        "Add the controls that lack, or mark the code that has them.",
    ),
    "asymmetric_protection": (
        "`{route}` is guarded for some methods only",
        "{guarded} method(s) of `{route}` carry auth signals ({with}), {open} do not ({without}). What one method forbids may be done through another.",
        "Guard the open methods alike, or confirm that they are meant to be open.",
    ),
    "audit_gap": (
        "Nothing shows that access to sensitive assets is logged",
        "{n} sensitive asset(s) were found ({names}), but no sign of audit logging. What happened to them could not be told afterwards.",
        "Log actor, action, asset and outcome wherever a sensitive asset is touched.",
    ),
    "single_point_of_failure": (
        "All authentication hangs on the secret `{name}`",
        "`{name}` is the only secret that authentication seems to rest on. If it leaks, no authenticated route can be trusted.",
        "Rotate keys, verify in layers, or sign per tenant.",
    ),
    "admin_action_without_auth": (
        "{n} privileged route(s) are public and show no auth signals",
        "{n} public route(s) look like administration or changes of roles, and none carries an auth signal. Who reaches them may grant themselves the rest.",
        "Authenticate and authorize at each of these routes, and test that the guard runs.",
    ),
    "control_bypass": (
        "{n} route(s) stand outside `{control}`",
        "`{control}` is placed in {files} files, as if for all routes, but not in the files of these: webhooks, health checks or internal handlers are often left out on purpose, and sometimes not.",
        "Write down why each is left out, and what guards it instead.",
    ),
    "trust_boundary_violation": (
        "{n} handler(s) in internal folders are public",
        "These handlers lie in folders that are named for internal use, yet their routes are public, as when a router includes a module by accident.",
        "Take the public route away, or move the handler out of the internal folder.",
    ),
    "stale_or_contradictory_signal": (
        "{n} harmless route(s) carry auth signals",
        "Health, status and static routes seldom need authentication. Their auth signals are likely those of the whole file, so take them with care.",
        "Mark public routes in code, so that signals of the file aren't taken for theirs.",
    ),
}
SEVERITY_ORDER = ("critical", "high", "medium", "low", "informational")
CONFIDENCE_ORDER = ("high", "medium", "low")
COLUMNS = ("repo", "id", "kind", "title", "narrative", "severity", "confidence", "evidence", "assets", "controls", "routes", "action")


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with its names in braces replaced; what is put in is taken as it is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def none() -> Column:
    return F.array().cast("array<string>")


def insight(
    df: DataFrame,
    kind: str,
    id_: Column,
    severity: Column | str,
    evidence: Column,
    values: dict[str, Column],
    confidence: Column | str = "medium",
    assets: Column | None = None,
    controls: Column | None = None,
    routes: Column | None = None,
) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    title, narrative, action = (filled(t, values) for t in TEXTS[kind])
    related = [(x if x is not None else none()).alias(k) for k, x in (("assets", assets), ("controls", controls), ("routes", routes))]
    return df.select(
        "repo", id_.alias("id"), F.lit(kind).alias("kind"), title.alias("title"), narrative.alias("narrative"), lit(severity).alias("severity"),
        lit(confidence).alias("confidence"), evidence.alias("evidence"), *related, action.alias("action"),
    )


def top_lines(rows: DataFrame, keys: list[str], line: Column, n: int) -> DataFrame:
    """keys, n (how many rows), lines and routes of the first rows, in the order of seq."""
    few = first_rows(rows.select(*keys, "seq", "route", line.alias("line")), keys, ["seq"], n)
    listed = F.array_sort(F.collect_list(F.struct("rn", "line", "route")))
    shown = few.groupBy(*keys).agg(listed.alias("x")).select(
        *keys, F.transform("x", lambda x: x["line"]).alias("lines"), F.transform("x", lambda x: x["route"]).alias("routes")
    )
    return shown.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)


def surface_line(note: Column | str) -> Column:
    return text(F.col("method"), " ", F.col("route"), " (", location(F.col("file"), F.col("line")), ")", note)


def shared_secret(scan: Scan, assets: DataFrame) -> DataFrame:
    """Secret names in three modules or more; of names that differ in case alone, the first counts."""
    rows = scan.secret_hint.where(~low_quality_ext(F.col("file")))
    keys = ["repo", "name"]
    found = rows.groupBy(*keys).agg(F.count_distinct(module_of(F.col("file"))).alias("modules"), F.count_distinct("file").alias("files"), F.min("seq").alias("seq"))
    found = found.join(first_values(rows, keys, location(F.col("file"), F.col("line")), 8, "e"), keys)
    one = first_rows(found.where("modules >= 3").withColumn("low", F.lower("name")), ["repo", "low"], ["seq"])
    held = assets.select("repo", "id", F.explode("locations").alias("file"))
    near = rows.select("repo", "name", "file").distinct().join(held, ["repo", "file"]).groupBy("repo", "name").agg(sorted_set("id").alias("assets"))
    g = one.join(near, ["repo", "name"], "left")
    evidence = F.array_join(F.transform("e", lambda x: F.concat(F.col("name"), F.lit(" ("), x, F.lit(")"))), " | ")
    severity = F.when(has_any(F.col("low"), SECRET_WORDS), "high").otherwise("medium")
    values = {k: F.col(k) for k in ("name", "modules", "files")}
    confidence = F.when(F.col("modules") >= 4, "high").otherwise("medium")
    return insight(g, "shared_secret_blast_radius", text("insight:shared-secret:", F.col("low")), severity, evidence, values, confidence, F.coalesce("assets", none()))


def asset_reachability(surfaces: DataFrame, assets: DataFrame) -> DataFrame:
    """Sensitive assets with a public surface without auth signals in one of their modules."""
    held = assets.where(sensitive()).select("repo", F.col("id").alias("asset"), F.col("name").alias("asset_name"), "criticality", F.explode("locations").alias("l"))
    modules = held.withColumn("module", module_of(F.col("l"))).drop("l").distinct()
    open_ = surfaces.where((F.col("exposure") == "public") & ~F.col("guarded")).withColumn("module", module_of(F.col("file")))
    g = top_lines(open_.join(modules, ["repo", "module"]), ["repo", "asset", "asset_name", "criticality"], surface_line(" - public, no auth"), 5)
    values = {"asset": F.col("asset_name"), "criticality": F.col("criticality"), "n": F.col("n")}
    severity = F.when(F.col("criticality") == "critical", "critical").otherwise("high")
    return insight(g, "sensitive_asset_reachability", text("insight:asset-reachable:", F.col("asset")), severity, F.array_join("lines", " | "), values, assets=F.array("asset"), routes=F.col("routes"))


def defense_gap(paths: DataFrame, controls: DataFrame) -> DataFrame:
    """Attack paths that end at data, in repositories without the controls one would expect on the way."""
    there = controls.where("strength <> 'absent'").groupBy("repo").agg(F.collect_set("kind").alias("kinds"))
    ends = has_any(F.lower(F.concat_ws(" ", "steps")), DATA_WORDS)
    rows = paths.where((F.col("place") <= 8) & ends).join(there, "repo", "left")
    missing = F.array_join(F.array_except(F.array(*map(F.lit, ON_THE_WAY)), F.coalesce("kinds", none())), ", ")
    rows = rows.withColumn("missing", missing).where("missing <> ''")
    values = {"path": F.col("name"), "missing": F.col("missing")}
    severity = F.when(F.col("missing").contains("authentication"), "high").otherwise("medium")
    return insight(rows, "defense_gap_in_chain", text("insight:defense-gap:", F.col("place").cast("string")), severity, F.array_join(F.slice("steps", 1, 6), " | "), values)


def strength_mismatch(assets: DataFrame, controls: DataFrame) -> DataFrame:
    """Critical and high assets whose expected controls are missing or weak alone."""
    kinds = F.create_map(*(x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    graded = assets.where(F.col("criticality").isin("critical", "high"))
    asked = graded.select("repo", F.col("id").alias("asset"), F.col("name").alias("asset_name"), "criticality", F.posexplode(kinds[F.col("kind")]).alias("o", "kind"))
    there = controls.where("strength <> 'absent'").groupBy("repo", "kind").agg(F.bool_and(F.col("strength") == "weak").alias("weak"))
    gap = F.when(F.col("weak").isNull(), text(F.col("kind"), " (absent)")).when(F.col("weak"), text(F.col("kind"), " (weak only)"))
    rows = asked.join(there, ["repo", "kind"], "left").withColumn("gap", gap)
    said = lambda value: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("o", "kind", "gap"))), lambda x: x[value]), lambda x: x.isNotNull()), ", ")
    g = rows.groupBy("repo", "asset", "asset_name", "criticality").agg(said("gap").alias("gaps"), said("kind").alias("expected")).where("gaps <> ''")
    values = {"asset": F.col("asset_name"), "criticality": F.col("criticality"), "gaps": F.col("gaps"), "expected": F.col("expected")}
    severity = F.when(F.col("criticality") == "critical", "high").otherwise("medium")
    evidence = F.array_join(F.transform(F.split("expected", ", "), lambda k: F.concat(F.lit("asset:"), F.col("asset"), F.lit(" expects "), k)), " | ")
    return insight(g, "control_strength_mismatch", text("insight:strength-mismatch:", F.col("asset")), severity, evidence, values, assets=F.array("asset"))


def asymmetric(surfaces: DataFrame) -> DataFrame:
    safe = F.col("guarded")
    methods = lambda on: F.array_join(sorted_set(F.when(on, F.col("method"))), ", ")
    g = surfaces.groupBy("repo", "route").agg(F.count_if(safe).alias("p"), F.count_if(~safe).alias("u"), methods(safe).alias("w"), methods(~safe).alias("o"))
    values = {"route": F.col("route"), "guarded": F.col("p"), "with": F.col("w"), "open": F.col("u"), "without": F.col("o")}
    evidence = text("guarded: ", F.col("w"), " | open: ", F.col("o"))
    return insight(g.where("p > 0 and u > 0"), "asymmetric_protection", text("insight:asymmetric:", F.col("route")), "medium", evidence, values, routes=F.array("route"))


def audit_gap(assets: DataFrame, controls: DataFrame) -> DataFrame:
    logged = controls.where("kind = 'audit_logging' and strength <> 'absent'").select("repo").distinct()
    rows = assets.where(sensitive(PROTECTED_KINDS)).join(logged, "repo", "left_anti")
    order = F.struct(rank_of(F.col("criticality"), CRITICALITY).alias("r"), "kind", "id", "criticality")
    names = F.left(F.array_join(sorted_set("name"), ", "), F.lit(160))
    g = rows.groupBy("repo").agg(F.count("*").alias("n"), names.alias("names"), F.array_sort(F.collect_set(order)).alias("x"))
    evidence = F.array_join(F.transform(F.slice("x", 1, 6), lambda x: F.concat(F.lit("asset:"), x["id"], F.lit(" ("), x["criticality"], F.lit(")"))), " | ")
    return insight(g, "audit_gap", F.lit("insight:audit-gap:global"), "medium", evidence, {"n": F.col("n"), "names": F.col("names")}, assets=F.transform("x", lambda x: x["id"]))


def single_point(scan: Scan, controls: DataFrame) -> DataFrame:
    auth = controls.where("kind = 'authentication' and strength <> 'absent'").select("repo").distinct()
    names = scan.secret_hint.where(~low_quality_ext(F.col("file")) & has_any(F.lower("name"), AUTH_SECRET_WORDS))
    g = names.groupBy("repo").agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")).where("n = 1").join(auth, "repo", "left_semi")
    return insight(g, "single_point_of_failure", text("insight:spof:", F.lower("name")), "high", text("secret:", F.col("name")), {"name": F.col("name")})


def surface_insights(surfaces: DataFrame) -> DataFrame:
    """The three rules that look at one surface at a time, in one pass: privileged, internal by folder, harmless."""
    c = F.col
    public, safe, admin = c("exposure") == "public", F.col("guarded"), c("category") == "admin"
    low = F.lower("route")
    rules = (
        (
            "admin_action_without_auth",
            public & (F.upper("method").isin(*STATE_CHANGING) | admin) & ~safe & (admin | has_any(low, ADMIN_PARTS)),
            " - public, no auth",
            6,
            "insight:admin-without-auth",
            "critical",
        ),
        ("trust_boundary_violation", public & has_any(wrapped(c("file")), INTERNAL_PARTS), " - internal by path, public", 5, "insight:trust-boundary-violation", "high"),
        ("stale_or_contradictory_signal", safe & has_any(low, BENIGN_PARTS), " - auth on a benign route", 5, "insight:stale-signal", "informational"),
    )
    hit = F.array_compact(F.array(*(F.when(on, F.struct(F.lit(k).alias("kind"), F.lit(note).alias("note"), F.lit(n).alias("most"))) for k, on, note, n, _, _ in rules)))
    rows = surfaces.select("repo", "seq", "route", "method", "file", "line", F.inline(hit))
    found = top_lines(rows, ["repo", "kind", "most"], surface_line(c("note")), 6)
    first, lines = F.slice("routes", F.lit(1), c("most")), F.array_join(F.slice("lines", F.lit(1), c("most")), " | ")
    parts = [insight(found.where(c("kind") == k), k, F.lit(name), level, lines, {"n": c("n")}, routes=first) for k, _, _, _, name, level in rules]
    return union(parts)


def control_bypass(surfaces: DataFrame, controls: DataFrame) -> DataFrame:
    """Routes that often stand outside a control, in files without it, where the control is in two files or more."""
    there = controls.where(F.col("kind").isin(*BYPASSED) & (F.col("strength") != "absent")).withColumnRenamed("kind", "control")
    placed = there.select("repo", "control", F.explode("placements").alias("file")).distinct()
    broad = placed.groupBy("repo", "control").agg(F.count("*").alias("files")).where("files >= 2")
    prone = surfaces.where((F.col("exposure") == "public") & has_any(F.lower("route"), BYPASS_PARTS)).join(broad, "repo").join(placed, ["repo", "control", "file"], "left_anti")
    ids = there.groupBy("repo", "control").agg(sorted_set("id").alias("ids"))
    g = top_lines(prone, ["repo", "control", "files"], surface_line(" - not in this file"), 5).join(ids, ["repo", "control"])
    values = {k: F.col(k) for k in ("n", "control", "files")}
    return insight(g, "control_bypass", text("insight:control-bypass:", F.col("control")), "medium", F.array_join("lines", " | "), values, controls=F.col("ids"), routes=F.col("routes"))


def generate_insights(scan: Scan, surfaces: DataFrame, paths: DataFrame, assets: DataFrame, controls: DataFrame) -> DataFrame:
    """All insights; the keys of each rule keep ids from repeating within a repository."""
    parts = [
        shared_secret(scan, assets), asset_reachability(surfaces, assets), defense_gap(paths, controls), strength_mismatch(assets, controls),
        asymmetric(surfaces), audit_gap(assets, controls), single_point(scan, controls), surface_insights(surfaces), control_bypass(surfaces, controls),
    ]
    return reduce(DataFrame.unionByName, parts).select(*COLUMNS)


def insight_order() -> list[Column | str]:
    return [rank_of(F.col("severity"), SEVERITY_ORDER), rank_of(F.col("confidence"), CONFIDENCE_ORDER), "kind", "id"]


def ordered_insights(insights: DataFrame) -> DataFrame:
    """Insights with their place in the repository: by severity, confidence, kind and id."""
    return insights.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(*insight_order())))


def context(controls: DataFrame) -> DataFrame:
    """repo, kind, present, absent: how many controls of a kind are there and how many are missed."""
    there = F.col("strength") != "absent"
    return controls.groupBy("repo", "kind").agg(F.count_if(there).alias("present"), F.count_if(~there).alias("absent"))

