"""Registered queries of the security-fact engine: every operator over the made repositories, with its oracle."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import expressions as E
from factloom.operators import chains, markdown, overlay, ranking, signals, surfaces, threats
from factloom.plans import extracts as extract_plans
from factloom.plans import markdowns as markdown_plans
from factloom.plans import overlays as overlay_plans
from factloom.plans import registries as registry_plans
from factloom.plans import reviews as review_plans
from factloom.plans import rubrics as rubric_plans
from factloom.plans.oracles import AUTH_LIKE, EVIDENCE, even, low, low_ext, oracle, rank, row_sql, row_text
from factloom.sources.adapters import FAMILIES, Scan, load
from factloom.sources.staged import settled, settled_together

Query = Callable[[SparkSession, str], DataFrame]


class Analysis:
    """Everything derived from one data directory, each relation built when asked for.

    The scan's relations, and those derived from them that others read, are written to the shared folder, so they are
    computed once, plans over them are short, and a lost executor loses none of them; nothing is kept in memory. The
    tables are taken as unchanged for as long as a session lasts.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        scan = load(spark, sf_dir)
        self.scan = Scan(**settled_together({f.name: getattr(scan, f.name) for f in fields(scan)}))

    @cached_property
    def clean(self):
        filtered = signals.auth_filtered(self.scan)
        return filtered.with_hints(settled(filtered.hint, "clean_hints"))

    @cached_property
    def surfaces(self) -> DataFrame:
        return settled(surfaces.classified(self.clean), "surfaces")

    @cached_property
    def raw_surfaces(self) -> DataFrame:
        return settled(surfaces.classified(self.scan), "raw_surfaces")

    @cached_property
    def findings(self) -> DataFrame:
        return settled(threats.generate_findings(self.clean, self.surfaces), "findings")

    @cached_property
    def paths(self) -> DataFrame:
        return settled(threats.generate_attack_paths(self.scan, self.raw_surfaces), "paths")

    @cached_property
    def assets(self) -> DataFrame:
        return settled(overlay.detect_assets(self.clean), "assets")

    @cached_property
    def controls(self) -> DataFrame:
        return settled(overlay.detect_controls(self.clean, self.surfaces, self.assets), "controls")

    def ahead(self, *names: str) -> None:
        """Build relations that don't read each other side by side; what they share is built before."""
        self.clean, self.surfaces  # noqa: B018
        with ThreadPoolExecutor(len(names)) as pool:
            list(pool.map(self.__getattribute__, names))

    @cached_property
    def insights(self) -> DataFrame:
        self.ahead("paths", "controls")
        return settled(overlay.generate_insights(self.clean, self.surfaces, self.paths, self.assets, self.controls), "insights")

    @cached_property
    def opportunities(self) -> DataFrame:
        self.ahead("findings", "insights")
        return settled(overlay.detection_opportunities(self.insights, self.findings), "opportunities")

    @cached_property
    def whole_opportunities(self) -> DataFrame:
        self.ahead("findings", "insights")
        return settled(overlay.detection_opportunities(self.insights, self.findings, whole=True), "whole_opportunities")

    @cached_property
    def scored_findings(self) -> DataFrame:
        return settled(markdown.scored_findings(self.findings, self.surfaces, self.paths), "scored_findings")

    def overlay_with(self, opportunities: DataFrame) -> overlay.Overlay:
        return overlay.Overlay(self.assets, self.controls, overlay.insight_techniques(self.insights), overlay.finding_techniques(self.findings), opportunities)

    @property
    def overlay(self) -> overlay.Overlay:
        return self.overlay_with(self.opportunities)

    @property
    def whole_overlay(self) -> overlay.Overlay:
        """The overlay whose opportunities name all that they relate to."""
        return self.overlay_with(self.whole_opportunities)


@lru_cache(4)
def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """One analysis of a directory for all queries of a session."""
    return Analysis(spark, sf_dir)


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


QUERIES_OF: dict[str, Callable[[Analysis], DataFrame]] = {}


def add(name: str, build: Callable[[Analysis], DataFrame], sql: str | None) -> None:
    QUERIES_OF[name] = build
    QUERIES[name] = lambda spark, sf_dir: build(analysis(spark, sf_dir))
    if sql:
        ORACLES[name] = oracle(sql)


c = F.col


def text_of(*names: str) -> list[Column]:
    return [F.array_join(n, ", ").alias(n) for n in names]


# Merging and the stream of all signals

for key, table, columns in (
    ("mrg_routes", "route", "path, method, file"),
    ("mrg_external_calls", "external_call", "target, file"),
    ("mrg_databases", "database_hint", "kind, file"),
    ("mrg_secrets", "secret_hint", "name, file"),
):
    add(
        key,
        lambda a, t=table: getattr(signals.merged(a.scan), t).drop("seq", "confidence"),
        f"SELECT repo, {columns}, line FROM (SELECT *, row_number() OVER (PARTITION BY repo, {columns} ORDER BY seq) AS rn FROM {table}) WHERE rn = 1",
    )
for name in FAMILIES:
    add(
        f"mrg_{name}",
        lambda a, n=name: signals.family(signals.merged(a.scan), n).select("repo", "hint", "file", "line", "confidence"),
        f"SELECT repo, hint, file, line, confidence FROM (SELECT *, row_number() OVER (PARTITION BY repo, hint, file ORDER BY seq) AS rn FROM hint WHERE family = '{name}') WHERE rn = 1",
    )
add(
    "mrg_initial_seen",
    lambda a: signals.with_earlier(a.scan.secret_hint, a.scan.secret_hint.where("seq % 2 = 0"), ["name", "file"]).select("repo", "name", "file", "line"),
    "SELECT repo, name, file, line FROM (SELECT *, row_number() OVER (PARTITION BY repo, name, file ORDER BY seq) AS rn FROM secret_hint) x WHERE rn = 1"
    " AND NOT EXISTS (SELECT 1 FROM secret_hint e WHERE e.seq % 2 = 0 AND e.repo = x.repo AND e.name = x.name AND e.file = x.file)",
)
add("mrg_counts", lambda a: signals.scan_meta(signals.merged(a.scan)), """SELECT r.repo, (SELECT count(DISTINCT file) FROM (SELECT repo, file FROM route UNION ALL SELECT repo, file FROM external_call UNION ALL SELECT repo, file FROM database_hint UNION ALL SELECT repo, file FROM hint UNION ALL SELECT repo, file FROM secret_hint) f WHERE f.repo = r.repo) AS n_files,
  (SELECT count(DISTINCT (path, method, file)) FROM route x WHERE x.repo = r.repo) AS n_routes, (SELECT count(DISTINCT (target, file)) FROM external_call x WHERE x.repo = r.repo) AS n_calls, (SELECT count(DISTINCT (kind, file)) FROM database_hint x WHERE x.repo = r.repo) AS n_databases,
  (SELECT count(DISTINCT (family, hint, file)) FROM hint x WHERE x.repo = r.repo) AS n_hints, (SELECT count(DISTINCT (name, file)) FROM secret_hint x WHERE x.repo = r.repo) AS n_secrets FROM repo r""")
PLACE = "file || CASE WHEN line IS NULL THEN '' ELSE ':' || line END"
STREAM = f"""SELECT repo, 'route' AS kind, method || ' ' || path AS label, {PLACE} AS place, 0.7::DOUBLE AS confidence, method, path, NULL AS db_kind FROM route UNION ALL SELECT repo, 'external_call', target, {PLACE}, 0.7::DOUBLE, NULL, NULL, NULL FROM external_call
  UNION ALL SELECT repo, 'database', kind, {PLACE}, 0.7::DOUBLE, NULL, NULL, kind FROM database_hint UNION ALL SELECT repo, family, hint, {PLACE}, confidence, NULL, NULL, NULL FROM hint UNION ALL SELECT repo, 'secret', name, {PLACE}, confidence, NULL, NULL, NULL FROM secret_hint"""
add("mrg_all_signals", lambda a: signals.all_signals(a.scan).drop("file", "line", "evidence", "seq"), STREAM)
add("mrg_location", lambda a: a.scan.route.select("repo", "path", "method", E.location(c("file"), c("line")).alias("place")), f"SELECT repo, path, method, {PLACE} AS place FROM route")

# Translation

add("xlt_is_auth_signal", lambda a: a.scan.hint.select("hint", signals.is_auth_signal(c("hint")).alias("is_auth")).distinct(), "SELECT DISTINCT hint, " + AUTH_LIKE + " AS is_auth FROM hint")
add("xlt_auth_filter", lambda a: a.clean.hint.select("repo", "family", "hint", "file", "line", "confidence"), "SELECT repo, family, hint, file, line, confidence FROM clean")

# Surfaces

SURFACE = ("repo", "route", "method", "file", "line", "category", "exposure", "risk", "data_store", "outbound", "rationale")


def whole(df: DataFrame, scan: Scan) -> DataFrame:
    return surfaces.expanded(df, scan).select(*SURFACE, *text_of("auth_signals"))


SURFACE_SQL = f"SELECT {', '.join(SURFACE)}, array_to_string(auth_signals, ', ') AS auth_signals FROM "
add("identify_attack_surfaces", lambda a: whole(a.raw_surfaces, a.scan), SURFACE_SQL + "surf_raw")
add("xlt_to_surface", lambda a: whole(a.surfaces, a.clean), SURFACE_SQL + "surf")
for key, columns in (
    ("sur_category", "category"),
    ("sur_risk", "category, risk"),
    ("sur_exposure", "exposure"),
    ("sur_flags", "data_store, outbound"),
    ("sur_rationale", "rationale"),
):
    add(key, lambda a, k=columns: (surfaces.expanded(a.surfaces, a.clean) if k == "rationale" else a.surfaces).select("repo", "route", "method", "file", *k.split(", ")), f"SELECT repo, route, method, file, {columns} FROM surf")
# Every surface, and how many of its repository share its class.
OVERRIDDEN = ["repo", "category", "exposure", "risk"]
add(
    "sur_internal_override",
    lambda a: E.with_count(a.surfaces.select("repo", "route", "method", "file", *OVERRIDDEN[1:]), OVERRIDDEN),
    f"SELECT repo, route, method, file, category, exposure, risk, count(*) OVER (PARTITION BY {', '.join(OVERRIDDEN)}) AS n FROM surf",
)
add(
    "sur_auth_attribution",
    lambda a: surfaces.attributed(a.clean, ("auth",), "h").select("repo", "path", "method", "file", F.array_join("h", ",").alias("hints")),
    "SELECT repo, route AS path, method, file, array_to_string(auth_signals, ',') AS hints FROM surf",
)
add(
    "sur_supporting_attribution",
    lambda a: surfaces.attributed(a.scan, FAMILIES, "h").select("repo", "path", "method", "file", F.array_join("h", ",").alias("hints")),
    "SELECT r.repo, path, method, r.file, coalesce(f.h, g.h, '') AS hints FROM route r LEFT JOIN (SELECT repo, file,"
    " array_to_string(list_sort(list(DISTINCT hint)), ',') AS h FROM hint GROUP BY ALL) f ON f.repo = r.repo AND f.file = r.file LEFT JOIN (SELECT repo,"
    " array_to_string(list_sort(list(DISTINCT hint)), ',') AS h FROM hint GROUP BY ALL) g ON g.repo = r.repo",
)
NODES = (
    "SELECT repo, 'repo' AS node, 'repository' AS label FROM repo UNION ALL SELECT DISTINCT repo, 'web', 'web_app' FROM route UNION ALL"
    " SELECT DISTINCT repo, 'db_' || kind, kind FROM database_hint UNION ALL SELECT repo, 'external_' || row_number() OVER (PARTITION BY repo"
    " ORDER BY seq), target FROM external_call"
)
add("arch_graph", lambda a: surfaces.architecture_graph(a.scan)[0], NODES)
add(
    "arch_graph_edges",
    lambda a: surfaces.architecture_graph(a.scan)[1],
    "SELECT DISTINCT repo, 'repo' AS source, 'web' AS target, 'contains' AS relation FROM route UNION ALL SELECT DISTINCT repo, 'repo', 'db_' || kind,"
    " 'uses' FROM database_hint UNION ALL SELECT repo, 'repo', 'external_' || row_number() OVER (PARTITION BY repo ORDER BY seq), 'calls'"
    " FROM external_call",
)
add("arch_summary", lambda a: surfaces.architecture_summary(a.scan), """SELECT r.repo, (SELECT count(*) FROM route x WHERE x.repo = r.repo) AS n_routes, (SELECT count(*) FROM secret_hint x WHERE x.repo = r.repo) AS n_secrets,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT kind)), ', ') FROM database_hint x WHERE x.repo = r.repo), 'none') AS datastores, coalesce((SELECT array_to_string(list_sort(list(DISTINCT target)), ', ') FROM external_call x WHERE x.repo = r.repo), 'none') AS targets,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT hint)), ', ') FROM hint x WHERE x.repo = r.repo AND family = 'auth'), 'none') AS auth,
  coalesce((SELECT string_agg(file || ':' || n, ', ' ORDER BY n DESC, s) FROM (SELECT file, count(*) AS n, min(seq) AS s FROM route x WHERE x.repo = r.repo GROUP BY file ORDER BY n DESC, s LIMIT 3)), 'none') AS busiest FROM repo r""")
SECTIONS = {
    "highest_risk": "risk = 'high'",
    "auth_and_admin": "category IN ('auth', 'admin')",
    "public": "exposure = 'public' AND category NOT IN ('auth', 'admin', 'health')",
    "operational": "category IN ('health', 'internal')",
}
TRAITS = (
    "CASE WHEN len(auth_signals) > 0 THEN 'auth signals: ' || array_to_string(auth_signals, ', ') ELSE 'no auth signals observed' END || CASE"
    " WHEN data_store THEN '; data store reachable' ELSE '' END || CASE WHEN outbound THEN '; external trust boundary' ELSE '' END"
)
add(
    "surface_summary",
    lambda a: surfaces.surface_summary(a.surfaces, a.clean),
    " UNION ALL ".join((
        f"SELECT repo, '{k}' AS section, rn::INTEGER AS place, method, route, file, {TRAITS} AS traits FROM (SELECT *, row_number() OVER (PARTITION BY repo"
        f" ORDER BY {rank('risk', surfaces.RISKS)}, route, method, seq) AS rn FROM surf WHERE {w}) WHERE rn <= 10"
    ) for k, w in SECTIONS.items()),
)
add(
    "surface_counts",
    lambda a: surfaces.surface_counts(a.surfaces),
    "SELECT repo, count(*) FILTER (WHERE risk = 'high') AS n_high, count(*) FILTER (WHERE exposure = 'public') AS n_public,"
    " count(*) FILTER (WHERE exposure = 'internal') AS n_internal, count(*) FILTER (WHERE data_store) AS n_data, count(*) FILTER (WHERE outbound)"
    " AS n_outbound FROM surf GROUP BY repo",
)
add("surface_traits", lambda a: surfaces.traits(surfaces.expanded(a.surfaces, a.clean)).select("repo", "traits").distinct(), f"SELECT DISTINCT repo, {TRAITS} AS traits FROM surf")

# Chains

for key, prefix in (("chn_prefixed_hints", "service_name:"), ("chn_prefixed_protocol", "atproto_lexicon:"), ("chn_prefixed_framework", "controller:")):
    add(
        key,
        lambda a, p=prefix: signals.prefixed_hints(a.scan, p).select("repo", "value", "file"),
        f"SELECT DISTINCT repo, substr(hint, {len(prefix) + 1}) AS value, file FROM hint WHERE starts_with(hint, '{prefix}') AND family IN ('auth',"
        f" '{next(f for p, f in signals.PREFIX_FAMILY if prefix.startswith(p))}')",
    )
add("chn_low_quality", lambda a: a.scan.route.select("file", E.low_quality(c("file")).alias("low")).distinct(), f"SELECT DISTINCT file, {low('file')} AS low FROM route")
add("chn_low_quality_ext", lambda a: a.scan.secret_hint.select("file", E.low_quality_ext(c("file")).alias("low")).distinct(), f"SELECT DISTINCT file, {low_ext('file')} AS low FROM secret_hint")
add("chn_runtime_routes", lambda a: chains.runtime_routes(a.scan).select("repo", "path", "method", "file"), f"SELECT repo, path, method, file FROM route WHERE NOT {low('file')}")
add("chn_edge_hints", lambda a: signals.edge_hints(a.scan).select("repo", "source", "target", "file"), "SELECT repo, source, target, file FROM edge WHERE source <> '' AND target <> ''")
add(
    "chn_service_from_path",
    lambda a: a.scan.route.select("file", E.service_from_path(c("file")).alias("service")).distinct(),
    "SELECT DISTINCT file, CASE WHEN regexp_matches(file, '(^|/)services/') THEN regexp_extract(file, '(?:^|/)services/([^/]+)', 1)"
    " WHEN regexp_matches(file, '(^|/)packages/') THEN regexp_extract(file, '(?:^|/)packages/([^/]+)', 1) WHEN regexp_matches(file,"
    " '(^|/)apps/') THEN regexp_extract(file, '(?:^|/)apps/([^/]+)', 1) END AS service FROM route",
)
add("chn_file_service_map", lambda a: signals.file_services(a.scan).select("repo", "file", "service"), "SELECT repo, file, service FROM services")
add(
    "chn_is_atproto",
    lambda a: a.scan.hint.groupBy("repo").agg(F.bool_or(c("family").isin("protocol", "auth") & c("hint").startswith("atproto_")).alias("gate")),
    "SELECT repo, bool_or(family IN ('protocol', 'auth') AND starts_with(hint, 'atproto_')) AS gate FROM hint GROUP BY repo",
)
add(
    "chn_is_mvc",
    lambda a: a.scan.hint.groupBy("repo").agg(F.bool_or(c("family").isin("framework", "auth") & c("hint").rlike("^(controller:|service:|omeka_|laminas_)")).alias("gate")),
    "SELECT repo, bool_or(family IN ('framework', 'auth') AND (starts_with(hint, 'controller:') OR starts_with(hint, 'service:') OR starts_with(hint,"
    " 'omeka_') OR starts_with(hint, 'laminas_'))) AS gate FROM hint GROUP BY repo",
)
add(
    "chn_xrpc_namespace",
    lambda a: a.scan.route.select("path", E.xrpc_namespace(c("path")).alias("namespace")).distinct(),
    "SELECT DISTINCT path, CASE WHEN contains(path, '/xrpc/com.atproto.') THEN 'com.atproto' WHEN contains(path, '/xrpc/app.bsky.') THEN 'app.bsky' END AS namespace FROM route",
)
add(
    "chn_module_key",
    lambda a: a.scan.route.select("file", E.module_key(c("file")).alias("module")).distinct(),
    "SELECT DISTINCT file, CASE WHEN contains(file, '/module/') THEN 'module/' || lower(string_split(string_split(file, '/module/')[2], '/')[1])"
    " ELSE lower(string_split(file, '/')[1]) END AS module FROM route",
)
add(
    "chn_guess_action",
    lambda a: a.scan.route.select("path", E.guess_action(c("path")).alias("action")).distinct(),
    "SELECT DISTINCT path, CASE WHEN contains(path, '/admin') THEN 'admin action' WHEN contains(path, '/api') THEN 'api action' WHEN starts_with(path,"
    " '/s/') OR contains(path, '/site') THEN 'site action' END AS action FROM route",
)
for key, build, name, own in (
    ("chn_service", chains.service_chains, "service", "entry_service, next_service, env_risk"),
    ("chn_atproto", chains.atproto_chains, "atproto", "namespace, entry_service, next_service, env_risk"),
    ("chn_framework", chains.framework_chains, "framework", "controller, action, service"),
):
    add(
        key,
        lambda a, b=build, k=own: b(a.scan).select("repo", "method", "path", "file", "sink", "confidence", *k.split(", "), F.array_join("evidence", " | ").alias("evidence")),
        f"SELECT repo, method, path, file, sink, confidence, {own}, array_to_string(evidence, ' | ') AS evidence FROM {name}_chain",
    )
    add(f"{key}_top", lambda a, b=build: chains.top_chain(b(a.scan)).select("repo", "method", "path", "file", "confidence"), f"SELECT repo, method, path, file, confidence FROM top_{name}")

# Findings and paths

add("xlt_to_findings", lambda a: a.findings, "SELECT repo, rule, title, severity, confidence, evidence FROM finding")
for rule, key in {**{k: f"fnd_{k}" for k in threats.FINDINGS}, **{k: f"fnd_{k}_chain" for k in threats.CHAIN_FINDINGS}}.items():
    add(key, lambda a, r=rule: a.findings.where(c("rule") == r).drop("rule"), f"SELECT repo, title, severity, confidence, evidence FROM finding WHERE rule = '{rule}'")
add("fnd_evidence_text", lambda a: surfaces.expanded(a.surfaces, a.clean).select("repo", threats.evidence_of().alias("evidence")), "SELECT repo, " + EVIDENCE + " AS evidence FROM surf")
add(
    "fnd_order",
    lambda a: E.first_rows(a.findings, ["repo"], threats.finding_order(), 50).select("repo", c("rn").alias("place"), "title"),
    f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY {rank('severity', threats.SEVERITIES)}, title)::INTEGER AS place, title FROM finding",
)
add(
    "xlt_to_paths",
    lambda a: a.paths.select("repo", "place", "kind", "name", F.array_join("steps", " | ").alias("steps")),
    "SELECT repo, place, kind, name, array_to_string(steps, ' | ') AS steps FROM path",
)
for kind in threats.PATHS:
    add(
        f"pth_{kind}",
        lambda a, k=kind: a.paths.where(c("kind") == k).select("repo", "name", F.array_join("steps", " | ").alias("steps")),
        f"SELECT repo, name, array_to_string(steps, ' | ') AS steps FROM path WHERE kind = '{kind}'",
    )
add("pth_cap", lambda a: a.paths.groupBy("repo").agg(F.count("*").alias("n"), F.max("place").alias("last")), "SELECT repo, count(*) AS n, max(place) AS last FROM path GROUP BY repo")
add(
    "pth_claim_dedup",
    lambda a: a.paths.select("repo", F.regexp_extract(c("steps")[0], "^Entry: An attacker [a-z ]+ ([A-Z]+ .*? in [^,]+?)(,| as a| *$)", 1).alias("entry")).where("entry <> ''").groupBy("repo", "entry").agg(F.count("*").alias("n")),
    "SELECT repo, entry, count(*) AS n FROM (SELECT repo, regexp_extract(steps[1], '^Entry: An attacker [a-z ]+ ([A-Z]+ .*? in [^,]+?)(,| as a| *$)', 1)"
    " AS entry FROM path) WHERE entry <> '' GROUP BY ALL",
)

# Assets

ASSET_SQL = "SELECT repo, id, kind, name, criticality, array_to_string(locations, ', ') AS locations, array_to_string(evidence, ', ') AS evidence FROM "


def asset_text(df: DataFrame) -> DataFrame:
    return df.select("repo", "id", "kind", "name", "criticality", *text_of("locations", "evidence"))


add("ast_rules", lambda a: asset_text(overlay.rule_assets(a.clean)), ASSET_SQL + "rule_asset")
add("ast_gather", lambda a: overlay.asset_matches(a.clean).groupBy("repo", "kind").agg(F.count_distinct("file").alias("n_files")), "SELECT repo, kind, len(locations) AS n_files FROM rule_asset")
add("ast_secret_assets", lambda a: asset_text(overlay.secret_assets(a.clean)), ASSET_SQL + "secret_asset")
add("ast_business_fallback", lambda a: asset_text(a.assets.where("kind = 'business_data'")), ASSET_SQL + "asset WHERE kind = 'business_data'")
add("ast_detect", lambda a: asset_text(a.assets), ASSET_SQL + "asset")
add(
    "ast_order",
    lambda a: overlay.ordered_assets(a.assets),
    f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY {rank('criticality', overlay.CRITICALITY)}, kind, id)::INTEGER AS place, id FROM asset",
)

# Controls

add("ctl_signal_text", lambda a: overlay.signal_text(a.clean), "SELECT repo, hint AS label, file, line FROM clean UNION ALL SELECT repo, path, file, line FROM route")
add(
    "ctl_present",
    lambda a: overlay.present_controls(a.clean).select("repo", "id", "kind", "name", "strength", "scope", *text_of("placements", "evidence")),
    "SELECT repo, id, kind, name, strength, scope, array_to_string(placements, ', ') AS placements, array_to_string(evidence, ', ') AS evidence FROM present",
)
add("ctl_patterns", lambda a: overlay.present_controls(a.clean).groupBy("kind", "strength").agg(F.count("*").alias("n")), "SELECT kind, strength, count(*) AS n FROM present GROUP BY ALL")
for kind, _ in overlay.ABSENT:
    add(
        f"ctl_absent_{kind}",
        lambda a, k=kind: a.controls.where((c("strength") == "absent") & (c("kind") == k)).select("repo", "id", "name"),
        f"SELECT repo, id, name FROM absent WHERE kind = '{kind}'",
    )
add("ctl_detect", lambda a: a.controls.select("repo", "id", "kind", "name", "strength", "scope"), "SELECT repo, id, kind, name, strength, scope FROM control")

add("ctl_absent_csrf", QUERIES_OF["ctl_absent_csrf_protection"], "SELECT repo, id, name FROM absent WHERE kind = 'csrf_protection'")
PATH = "lower(replace(file, '\\', '/'))"
add("ast_location", lambda a: a.scan.secret_hint.select("repo", "name", E.location(c("file"), c("line")).alias("place")), f"SELECT repo, name, {PLACE} AS place FROM secret_hint")
add("ast_normalize", lambda a: a.scan.secret_hint.select("file", E.wrapped(c("file")).alias("path")).distinct(), f"SELECT DISTINCT file, '/' || {PATH} || '/' AS path FROM secret_hint")


#: The relations of a translation: their tables in the oracles, and their columns.
TRANSLATED = {
    "surface": ("surf", (*SURFACE[1:], "auth_signals")),
    "finding": ("finding", ("rule", "title", "severity", "confidence", "evidence")),
    "path": ("path", ("place", "kind", "name", "steps")),
}


def translated(a: Analysis) -> DataFrame:
    """The rows of all surfaces, findings and paths, when the three are made of a scan at once."""
    surf, *rest = threats.translated(a.scan)
    made = (surfaces.expanded(surf, a.clean), *rest)
    return overlay.union([row_text(df, k, columns) for df, (k, (_, columns)) in zip(made, TRANSLATED.items(), strict=True)])


add("xlt_translate", translated, " UNION ALL ".join(row_sql(t, k, columns, ("auth_signals", "steps")) for k, (t, columns) in TRANSLATED.items()))

# Insights, techniques and detections

overlay_plans.register(add)


# Ranking

PROTOCOL = "(contains(lower(file), 'lexicon') OR contains(lower(route), '/xrpc/') OR contains(lower(array_to_string(auth_signals, ' ')), 'atproto_'))"
CLASS = f"CASE WHEN {low('file')} THEN 'low_quality' WHEN {PROTOCOL} THEN 'protocol_derived' WHEN exposure = 'public' THEN 'observed_runtime' ELSE 'other' END"
CLASS_OF_EVIDENCE = (
    f"CASE WHEN {low('file')} THEN 'low_quality' WHEN {PROTOCOL} THEN 'inferred_protocol' WHEN exposure = 'public' THEN 'observed_runtime_public'"
    f" WHEN exposure = 'internal' THEN 'observed_runtime_internal' ELSE 'inferred' END"
)
POINTS = " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in ranking.PRIVILEGE)
SURFACE_TERMS = (
    "CASE WHEN exposure = 'public' THEN 6::DOUBLE ELSE 2::DOUBLE END",
    f"(CASE category {POINTS} ELSE 1::DOUBLE END) * 2",
    "CASE WHEN exposure = 'public' THEN 3::DOUBLE ELSE 1.5::DOUBLE END",
    "(CASE WHEN data_store THEN 2::DOUBLE ELSE 0::DOUBLE END + CASE WHEN outbound THEN 2::DOUBLE ELSE 0::DOUBLE END) * 1.5::DOUBLE",
    "CASE WHEN data_store AND outbound THEN 2::DOUBLE ELSE 1::DOUBLE END",
    "CASE WHEN len(auth_signals) > 0 THEN 2::DOUBLE ELSE 1::DOUBLE END",
    f"CASE WHEN {low('file')} THEN -8::DOUBLE WHEN {PROTOCOL} THEN -3::DOUBLE WHEN exposure = 'public' THEN 1::DOUBLE ELSE 0::DOUBLE END",
)
SCORE = even(" + ".join(SURFACE_TERMS), 2)
COUNTED = (
    f"SELECT repo, count(*) AS n, count(*) FILTER (WHERE {CLASS} = 'observed_runtime') AS o, count(*) FILTER (WHERE {CLASS} = 'protocol_derived') AS p,"
    f" count(*) FILTER (WHERE {CLASS} = 'low_quality') AS l FROM surf GROUP BY repo"
)
add(
    "rnk_protocol_derived",
    lambda a: a.surfaces.groupBy("repo").agg(F.count_if(ranking.protocol_derived()).alias("n")),
    f"SELECT repo, count(*) FILTER (WHERE {PROTOCOL}) AS n FROM surf GROUP BY repo",
)
add(
    "rnk_provenance",
    lambda a: ranking.provenance_shares(a.surfaces).drop("basis"),
    f"SELECT repo, round_even(o / n * 100, 0)::INTEGER AS observed, round_even(p / n * 100, 0)::INTEGER AS protocol, round_even(l / n * 100, 0)::INTEGER AS low FROM ({COUNTED})",
)
add(
    "rnk_basis_label",
    lambda a: ranking.provenance_shares(a.surfaces).select("repo", "basis"),
    f"SELECT repo, CASE WHEN o / t * 100 >= 50 THEN 'observed' WHEN p / t * 100 >= 50 THEN 'inferred-protocol'"
    f" WHEN l / t * 100 >= 50 THEN 'low-quality-evidence' ELSE 'mixed-evidence' END AS basis FROM (SELECT *, greatest(o + p + l, 1) AS t FROM ({COUNTED}))",
)
add(
    "rnk_entrypoint_counts",
    lambda a: a.surfaces.groupBy("repo", ranking.entrypoint_class().alias("class")).agg(F.count("*").alias("n")),
    f"SELECT repo, CASE WHEN {low('file')} THEN 'low_quality' WHEN exposure = 'internal' THEN 'internal_only' WHEN {PROTOCOL} THEN 'protocol_derived'"
    f" WHEN exposure = 'public' THEN 'runtime_public' END AS class, count(*) AS n FROM surf GROUP BY ALL",
)
add("rnk_surface", lambda a: ranking.surface_scores(a.surfaces).select("repo", "route", "method", "file", "score"), f"SELECT repo, route, method, file, {SCORE} AS score FROM surf")
add(
    "rnk_hotspots",
    lambda a: ranking.top_hotspots(a.surfaces),
    f"SELECT repo, rn::INTEGER AS place, method, route, category, score FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC,"
    f" {rank('risk', surfaces.RISKS)}, route DESC, seq) AS rn FROM (SELECT *, {SCORE} AS score FROM surf)) WHERE rn <= 2",
)

# Review views

review_plans.register(add, CLASS_OF_EVIDENCE)
markdown_plans.register(add, CLASS, review_plans.factor_list(SURFACE_TERMS), review_plans.path_score()[1])

# Review evaluation

rubric_plans.register(QUERIES, ORACLES)


# Extraction from made source files

extract_plans.register(QUERIES, ORACLES)


registry_plans.register(add, QUERIES, ORACLES)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
