"""Registered queries of insights, techniques and detections, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import expressions as E
from factloom.operators import insights, overlay, techniques, threats
from factloom.plans.oracles import LIBRARY, q, rank, row_sql, row_text, said

INSIGHTS = {
    "shared_secret": "shared_secret_blast_radius",
    "asset_reachability": "sensitive_asset_reachability",
    "defense_gap": "defense_gap_in_chain",
    "strength_mismatch": "control_strength_mismatch",
    "asymmetric": "asymmetric_protection",
    "audit_gap": "audit_gap",
    "spof": "single_point_of_failure",
    "admin_no_auth": "admin_action_without_auth",
    "control_bypass": "control_bypass",
    "trust_boundary": "trust_boundary_violation",
    "stale_signal": "stale_or_contradictory_signal",
}
c = F.col
RANKED = f"{rank('severity', insights.SEVERITY_ORDER)}, {rank('confidence', insights.CONFIDENCE_ORDER)}, kind, id"
ONE_A_KIND = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, kind ORDER BY {RANKED}) AS rn FROM ins_tech) WHERE rn = 1)"
BY_SEVERITY = rank("severity", threats.SEVERITIES)
TITLES = f"(SELECT DISTINCT repo, title, {BY_SEVERITY} AS r FROM finding)"
PLACED_FINDING = f"(SELECT repo, title, techniques, row_number() OVER (PARTITION BY repo ORDER BY {BY_SEVERITY}, title, rule) AS rn FROM fnd_tech WHERE repo NOT IN (SELECT repo FROM ins_tech))"
FIRST_TECHNIQUES = (
    "(SELECT repo, t, row_number() OVER (PARTITION BY repo ORDER BY min(rn * 100 + i)) AS p FROM "
    f"(SELECT repo, rn, unnest(techniques) AS t, generate_subscripts(techniques, 1) AS i FROM {PLACED_FINDING}) GROUP BY repo, t)"
)


def case(of: dict[str, str]) -> str:
    return "CASE kind " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in of.items()) + " END"


def advice(kind: str, routes: str = "list_slice(string_split(routes, ', '), 1, 3)") -> str:
    _, what, *default = techniques.ADVICE[kind]
    named = f"array_to_string(list_transform({routes}, lambda r: '`' || r || '`'), ', ')"
    return said(what, {"routes": f"CASE WHEN routes = '' THEN {q(default[0])} ELSE {named} END"}) if default else q(what)


SIGNAL = case({k: q(s) for k, (s, _) in techniques.DETECTIONS.items()})
TITLE = case({k: q(t) for k, (_, t) in techniques.DETECTIONS.items()})
WHY = case({k: q(a[0]) for k, a in techniques.ADVICE.items()})
WHAT = case({k: advice(k) for k in techniques.ADVICE})
WHAT_OF_ALL = case({k: advice(k, "string_split(routes, ', ')") for k in techniques.ADVICE})


def text(insight_rows: DataFrame) -> DataFrame:
    lists = {n: F.array_join(n, ", ") for n in ("assets", "controls", "routes")}
    return insight_rows.withColumns(lists)


def register(add: Callable) -> None:
    for key, kind in INSIGHTS.items():
        if key == "asymmetric":  # auth signals fall back to the whole repository's, so it can't fire on the scan's own surfaces
            continue
        add(f"ins_{key}", lambda a, k=kind: text(a.insights.where(c("kind") == k)), f"SELECT * FROM ins_{key}")
    add(
        "ins_asymmetric",
        lambda a: text(insights.asymmetric(a.surfaces.withColumn("guarded", F.expr("seq % 3 <> 0")))),
        LIBRARY["ins_asymmetric"].replace("FROM surf ", "FROM (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN [] ELSE ['jwt'] END AS auth_signals) FROM surf) "),
    )
    add(
        "ins_generate",
        lambda a: insights.ordered_insights(a.insights).select("repo", "place", "id", "kind", "severity", "confidence"),
        f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY {RANKED})::INTEGER AS place, id, kind, severity, confidence FROM insight",
    )
    add(
        "ins_context",
        lambda a: insights.context(a.controls),
        "SELECT repo, kind, count(*) FILTER (WHERE strength <> 'absent') AS present, count(*) FILTER (WHERE strength = 'absent') AS absent FROM control GROUP BY ALL",
    )
    add(
        "ins_module_of",
        lambda a: a.scan.route.select("file", E.module_of(c("file")).alias("module")).distinct(),
        "SELECT DISTINCT file, CASE WHEN contains(file, '/') THEN array_to_string(string_split(file, '/')[:-2], '/') ELSE file END AS module FROM route",
    )
    values = ", ".join(f"({q(i)}, {q(n)}, {q(t)})" for i, n, t in techniques.CATALOG)
    catalog = f"(SELECT *, 'https://attack.mitre.org/techniques/' || replace(technique, '.', '/') || '/' AS link FROM (VALUES {values}) t(technique, name, tactic))"
    for key, build, relation, own in (
        ("tax_insight_map", lambda a: overlay.insight_techniques(a.insights), "ins_tech", "id"),
        ("tax_finding_map", lambda a: overlay.finding_techniques(a.findings), "fnd_tech", "rule"),
    ):
        add(
            key,
            lambda a, b=build, o=own: b(a).select("repo", o, F.array_join("techniques", ",").alias("techniques")),
            f"SELECT repo, {own}, array_to_string(techniques, ',') AS techniques FROM {relation}",
        )
    # Every third row has techniques already; those stay.
    given = "CASE WHEN length(id) % 3 = 0 THEN array('T1071') END"
    add(
        "tax_annotate_insights",
        lambda a: overlay.insight_techniques(a.insights.withColumn("techniques", F.expr(given))).select("repo", "id", F.array_join("techniques", ",").alias("techniques")),
        "SELECT repo, id, CASE WHEN length(id) % 3 = 0 THEN 'T1071' ELSE array_to_string(techniques, ',') END AS techniques FROM ins_tech",
    )
    titled = "CASE WHEN length(title) % 2 = 0 THEN array('T1485', 'T1071') END"
    add(
        "tax_annotate_findings",
        lambda a: overlay.finding_techniques(a.findings.withColumn("techniques", F.expr(titled))).select("repo", "rule", F.array_join("techniques", ",").alias("techniques")),
        "SELECT repo, rule, CASE WHEN length(title) % 2 = 0 THEN 'T1485,T1071' ELSE array_to_string(techniques, ',') END AS techniques FROM fnd_tech",
    )
    used = "SELECT repo, technique, count(*) AS n FROM (SELECT repo, unnest(techniques) AS technique FROM ins_tech UNION ALL SELECT repo, unnest(techniques) FROM fnd_tech) GROUP BY ALL"

    def in_use(a) -> DataFrame:
        """The catalog, with how often its techniques are named and in how many repositories."""
        uses = overlay.technique_use(a.insights, a.findings).groupBy("technique").agg(F.sum("n").alias("n"), F.count("*").alias("n_repos"))
        return techniques.catalog(a.scan.repo.sparkSession).join(uses, "technique", "left").na.fill(0, ["n", "n_repos"])

    totals = f"SELECT technique, sum(n)::BIGINT AS n, count(*) AS n_repos FROM ({used}) GROUP BY technique"
    add("tax_catalog", in_use, f"SELECT k.*, coalesce(n, 0) AS n, coalesce(n_repos, 0) AS n_repos FROM {catalog} k LEFT JOIN ({totals}) USING (technique)")
    add("tax_flatten", lambda a: overlay.technique_use(a.insights, a.findings), f"SELECT u.*, name, tactic, link FROM ({used}) u JOIN {catalog} USING (technique)")
    paired = lambda a: a.opportunities.where("insight is not null")
    generators = (
        f"SELECT repo, 'detect:' || id AS id, {SIGNAL} AS signal, {TITLE} AS title, {WHY} AS rationale, {WHAT} AS rule, id AS insight,"
        f" array_to_string(techniques, ',') AS techniques FROM {ONE_A_KIND}"
    )
    add("det_generators", lambda a: paired(a).select("repo", "id", "signal", "title", "rationale", "rule", "insight", "techniques"), generators)
    add("det_first_per_kind", lambda a: paired(a).select("repo", "insight"), f"SELECT repo, id AS insight FROM {ONE_A_KIND}")
    word = "len(list_filter(string_split_regex(lower(o.t), '\\s+'), lambda w: length(w) > 4 AND contains(lower(t.title), w))) > 0"
    folded = (
        f"SELECT o.repo, o.id AS insight, coalesce((SELECT string_agg(title, ' | ' ORDER BY r, title) FROM (SELECT t.* FROM {TITLES} t WHERE t.repo = o.repo"
        f" AND {word} ORDER BY r, title LIMIT 3)), '') AS findings "
        f"FROM (SELECT *, {TITLE} AS t FROM {ONE_A_KIND}) o"
    )
    add("det_fold_findings", lambda a: paired(a).select("repo", "insight", "findings"), folded)
    residual = (
        f"SELECT * FROM (SELECT repo, 'detect:findings:residual' AS id, 'log' AS signal, string_agg(t, ',' ORDER BY p) FILTER (WHERE p <= 6) AS techniques FROM {FIRST_TECHNIQUES} GROUP BY repo) "
        f"JOIN (SELECT repo, string_agg(title, ' | ' ORDER BY rn) FILTER (WHERE rn <= 5) AS findings FROM {PLACED_FINDING} GROUP BY repo) USING (repo)"
    )
    add("det_residual", lambda a: a.opportunities.where("insight is null").select("repo", "id", "signal", "techniques", "findings"), residual)
    # The overlay as a whole: all rows of all its relations with all their columns, and how many a repository's relation has.
    # An opportunity names all findings, techniques and routes that it relates to; the det_ queries name the first ones.
    (own, signal, title), (why, what) = techniques.RESIDUAL, techniques.RESIDUAL_ADVICE
    columns = ", ".join(techniques.OPPORTUNITY)
    related = f"coalesce((SELECT string_agg(title, ' | ' ORDER BY r, title) FROM {TITLES} t WHERE t.repo = o.repo AND {word}), '')"
    opportunities = (
        f"(SELECT {columns} FROM (SELECT repo, 'detect:' || id AS id, {SIGNAL} AS signal, t AS title, {WHY} AS rationale, {WHAT_OF_ALL} AS rule, id AS insight,"
        f" array_to_string(techniques, ',') AS techniques, {related} AS findings FROM (SELECT *, {TITLE} AS t FROM {ONE_A_KIND}) o)"
        f" UNION ALL SELECT {columns} FROM (SELECT repo, {q(own)} AS id, {q(signal)} AS signal, {q(title)} AS title, {q(why)} AS rationale,"
        f" {q(what)} AS rule, NULL AS insight, string_agg(t, ',' ORDER BY p) AS techniques FROM {FIRST_TECHNIQUES} GROUP BY repo)"
        f" JOIN (SELECT repo, string_agg(title, ' | ' ORDER BY rn) AS findings FROM {PLACED_FINDING} GROUP BY repo) USING (repo))"
    )
    missed = f"(SELECT *, CASE WHEN strength = 'absent' THEN {case({k: q(v) for k, v in overlay.MISSED.items()})} END AS notes FROM control)"
    parts = {
        "assets": ("asset", ("id", "kind", "name", "criticality", "locations", "evidence"), ("locations", "evidence")),
        "controls": (missed, ("id", "kind", "name", "strength", "scope", "placements", "evidence", "notes"), ("placements", "evidence")),
        "insights": ("ins_tech", (*insights.COLUMNS[1:], "techniques"), ("techniques",)),
        "findings": ("fnd_tech", ("rule", "title", "severity", "confidence", "evidence", "techniques"), ("techniques",)),
        "opportunities": (opportunities, techniques.OPPORTUNITY[1:], ()),
    }

    def whole(a) -> DataFrame:
        made = a.whole_overlay
        rows = [row_text(getattr(made, k), k, columns) for k, (_, columns, _) in parts.items()]
        return E.with_count(overlay.union(rows), ["repo", "relation"])

    every = " UNION ALL ".join(row_sql(table, k, columns, lists) for k, (table, columns, lists) in parts.items())
    add("overlay_build", whole, f"SELECT *, count(*) OVER (PARTITION BY repo, relation) AS n FROM ({every})")
