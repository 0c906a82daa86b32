"""Registered queries of the review views, with their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import ranking, review, surfaces, threats
from factloom.plans.oracles import LIBRARY, any_of, even, low, place, q, rank
from factloom.sources.staged import settled

CLASSES = review.CLASSES


def counts(prefix: str = "") -> str:
    return ", ".join(f"count(*) FILTER (WHERE class = '{k}') AS {prefix}{k}" for k in CLASSES)


def basis(prefix: str) -> str:
    total = f"greatest({' + '.join(f'coalesce({prefix}{k}, 0)' for k in CLASSES)}, 1)"
    half = lambda *names: f"({' + '.join(f'coalesce({prefix}{n}, 0)' for n in names)}) * 2 >= {total}"
    return (
        f"CASE WHEN {half('observed_runtime_public', 'observed_runtime_internal')} THEN 'observed' WHEN {half('inferred_protocol')} THEN 'inferred_protocol'"
        f" WHEN {half('low_quality')} THEN 'low_quality' ELSE 'mixed' END"
    )


def mapped(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + " END"


CLAIM = "lower(title || ' ' || replace(evidence, ' | ', ' '))"
PLACED = f"row_number() OVER (PARTITION BY repo ORDER BY {rank('severity', threats.SEVERITIES)}, title, rule)"


FACTORS = ("exposure", "privilege", "reachability", "trust_boundary", "chain_depth", "confidence", "evidence_linkage", "source_quality", "source_quality_penalty")


def scored() -> str:
    """Findings with n and factors (a list of name and value), from the related surfaces and paths."""
    known = "list_max(list_transform(string_split(f.evidence, ' | '), lambda e: try_cast(regexp_extract(lower(e), 'confidence=([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE)))"
    number = lambda x: f"{x}::DOUBLE"
    privilege = "CASE WHEN category IN ('admin', 'auth') THEN 3.0::DOUBLE WHEN category IN ('webhook', 'upload') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
    reach = "CASE WHEN data_store THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN outbound THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END"
    stats = f"SELECT repo, rule, count(*) AS n, bool_or(exposure = 'public') AS pub, max({privilege}) AS privilege, max({reach}) AS reach, {counts()} FROM related GROUP BY repo, rule"
    depths = "SELECT repo, rule, max(least(len(steps), 8) / 2.0::DOUBLE) AS depth FROM related_path GROUP BY repo, rule"
    c = lambda k: f"coalesce(s.{k}, 0)::DOUBLE"
    bold = any_of("lower(f.title)", ("privilege", "admin", "auth", "token", "identity"))
    terms = {
        "exposure": "CASE WHEN coalesce(s.pub, false) THEN 6.0::DOUBLE ELSE 2.0::DOUBLE END",
        "privilege": f"greatest(coalesce(s.privilege, 1.0::DOUBLE), CASE WHEN {bold} THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END) * 2.0::DOUBLE",
        "reachability": "CASE WHEN coalesce(s.pub, false) THEN 3.0::DOUBLE ELSE 1.5::DOUBLE END",
        "trust_boundary": "coalesce(s.reach, 1.0::DOUBLE) * 2.0::DOUBLE",
        "chain_depth": "coalesce(d.depth, 0.5::DOUBLE) * 1.2::DOUBLE",
        "confidence": f"(CASE f.confidence WHEN 'high' THEN 3.0::DOUBLE WHEN 'medium' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END + coalesce({known}, 0.0::DOUBLE)) * 1.5::DOUBLE",
        "evidence_linkage": "CASE WHEN s.n IS NULL THEN -8.0::DOUBLE ELSE least(2.0::DOUBLE, s.n * 0.5::DOUBLE) END",
        "source_quality": f"{c('observed_runtime_public')} * 1.5::DOUBLE - {c('inferred_protocol')} * 0.5::DOUBLE - {c('low_quality')} * 3.0::DOUBLE",
        "source_quality_penalty": f"CASE WHEN {low('f.claim')} AND coalesce(s.low_quality, 0) = coalesce(s.n, 0) THEN -10.0::DOUBLE ELSE 0.0::DOUBLE END",
    }
    listed = ", ".join(f"struct_pack(name := {q(k)}, value := {number(f'({v})')})" for k, v in terms.items())
    return (
        f"SELECT f.repo, f.rule, f.title, coalesce(s.n, 0) AS n, [{listed}] AS factors FROM claims f LEFT JOIN ({stats}) s ON s.repo = f.repo"
        f" AND s.rule = f.rule LEFT JOIN ({depths}) d ON d.repo = f.repo AND d.rule = f.rule"
    )


def factor_list(terms: tuple[str, ...]) -> str:
    """Terms of a surface's or a path's score as a list of name and value."""
    names = ("exposure", "privilege", "reachability", "trust_boundary", "chain_depth", "confidence", "source_quality")
    return "[" + ", ".join(f"struct_pack(name := {q(k)}, value := ({t})::DOUBLE)" for k, t in zip(names, terms, strict=True)) + "]"


def path_score() -> tuple[str, str]:
    """The score of paths, and its factors over a relation with said, steps and name."""
    said = "lower(name || ' ' || array_to_string(steps, ' '))"
    hops = f"len(list_filter(steps, lambda s: {any_of('lower(s)', ranking.HOP_WORDS)})) + 1.0::DOUBLE"
    known = "try_cast(regexp_extract(said, 'confidence=([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE)"
    terms = (
        f"CASE WHEN {any_of('said', ('attacker reaches', 'public', '/xrpc/'))} THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END * 2.0::DOUBLE",
        f"CASE WHEN {any_of('said', ranking.PRIVILEGED_WORDS)} THEN 3.0::DOUBLE ELSE 1.5::DOUBLE END * 2.0::DOUBLE",
        "CASE WHEN len(list_filter(steps, lambda s: starts_with(lower(s), 'entry:'))) > 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * 1.5::DOUBLE",
        f"({hops}) * 2.0::DOUBLE",
        "greatest(1.0::DOUBLE, least(len(steps), 8) / 2.0::DOUBLE) * 1.2::DOUBLE",
        f"(coalesce({known}, 0.5::DOUBLE) + 1.5::DOUBLE) * 1.5::DOUBLE",
        f"CASE WHEN {low('said')} THEN -10.0::DOUBLE ELSE 0.0::DOUBLE END",
    )
    return f"SELECT repo, place, name, {even(' + '.join(terms), 2)} AS score FROM (SELECT *, {said} AS said FROM path)", factor_list(terms)


#: SQL of the views, by the names of their queries.
VIEWS: dict[str, str] = {}


def register(put: Callable[[str, Callable[[Any], Any], str | None], None], class_of: str) -> None:
    """Adds the queries; class_of is the SQL of a surface's evidence class."""

    def add(name: str, build: Callable[[Any], Any], sql: str | None) -> None:
        VIEWS[name] = sql or ""
        put(name, build, sql)

    LIBRARY["classed"] = f"SELECT *, {class_of} AS class FROM surf"
    LIBRARY["claims"] = f"SELECT *, {CLAIM} AS claim FROM finding"
    LIBRARY["related"] = (
        "SELECT f.repo, f.rule, f.claim, s.* EXCLUDE (repo) FROM claims f JOIN classed s ON f.repo = s.repo WHERE contains(f.claim, lower(s.route))"
        " OR contains(f.claim, lower(s.file)) OR contains(f.claim, lower(s.category))"
    )
    LIBRARY["every"] = f"SELECT repo, {counts('all_')} FROM classed GROUP BY repo"
    LIBRARY["related_counts"] = f"SELECT repo, rule, {counts()} FROM related GROUP BY repo, rule"
    LIBRARY["of_basis"] = (
        f"SELECT f.*, CASE WHEN r.low_quality IS NULL THEN {basis('e.all_')} ELSE {basis('r.')} END AS basis FROM finding f LEFT"
        f" JOIN related_counts r ON r.repo = f.repo AND r.rule = f.rule LEFT JOIN every e ON e.repo = f.repo"
    )
    joined = "lower(array_to_string(p.steps, ' '))"
    LIBRARY["routed"] = f"SELECT DISTINCT x.repo, x.rule, p.place FROM related x JOIN path p ON p.repo = x.repo WHERE x.route <> '' AND contains({joined}, lower(x.route))"
    LIBRARY["related_path"] = """SELECT f.repo, f.rule, p.place, p.name, p.steps FROM claims f JOIN path p ON p.repo = f.repo LEFT JOIN routed x ON x.repo = f.repo AND x.rule = f.rule AND x.place = p.place
      WHERE contains(f.claim, lower(p.name)) OR contains(f.claim, lower(p.steps[1])) OR contains(f.claim, lower(p.steps[2])) OR x.place IS NOT NULL"""
    classed, related, every, of_basis = "classed", "related", "every", "of_basis"
    acts = mapped("rule", review.MITIGATIONS)

    add("rvj_evidence_class", lambda a: a.surfaces.select("repo", "route", "method", "file", review.evidence_class().alias("class")), f"SELECT repo, route, method, file, class FROM {classed}")
    add("rvj_evidence_counts", lambda a: review.evidence_counts(a.surfaces), f"SELECT repo, {counts()} FROM {classed} GROUP BY repo")
    add(
        "rnk_related_surfaces",
        lambda a: review.related_surfaces(a.findings, a.surfaces).groupBy("repo", "rule").agg(F.count("*").alias("n")),
        f"SELECT repo, rule, count(*) AS n FROM {related} GROUP BY repo, rule",
    )
    add(
        "rnk_related_paths",
        lambda a: review.related_paths(a.findings, a.surfaces, a.paths),
        "SELECT repo, rule, place, name FROM related_path",
    )
    add(
        "rnk_numeric_confidence",
        lambda a: a.findings.select("repo", "rule", review.numeric_confidence(F.col("evidence")).alias("value")),
        "SELECT repo, rule, try_cast(regexp_extract(lower(evidence), 'confidence=([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS value FROM finding",
    )
    LIBRARY["scored"] = scored()
    total = " + ".join(f"list_filter(factors, lambda x: x.name = {q(k)})[1].value" for k in FACTORS)
    score = even(total, 2)
    add(
        "rnk_finding",
        lambda a: review.finding_scores(a.findings, a.surfaces, a.paths).select("repo", "rule", "title", "score", "n_related"),
        f"SELECT repo, rule, title, {score} AS score, n AS n_related FROM scored",
    )
    best = "list_slice(list_sort(list_transform(list_zip(factors, range(1, len(factors) + 1)), lambda z: struct_pack(down := -z[1].value, i := z[2], name := z[1].name))), 1, 3)"
    reasons = f"array_to_string(list_transform(list_filter({best}, lambda x: x.down < 0), lambda x: x.name || '=' || printf('%.1f', {even('-x.down', 1)})), ', ')"
    add("rnk_top_reasons", lambda a: review.finding_scores(a.findings, a.surfaces, a.paths).select("repo", "rule", "reasons"), f"SELECT repo, rule, {reasons} AS reasons FROM scored")
    add("rnk_path", lambda a: ranking.path_scores(a.paths).select("repo", "place", "name", "score"), path_score()[0])
    add("rvj_related", lambda a: review.with_basis(a.findings, a.surfaces).select("repo", "rule", "basis"), f"SELECT repo, rule, basis FROM {of_basis}")
    add("rvj_basis", lambda a: review.evidence_counts(a.surfaces).select("repo", review.basis().alias("basis")), f"SELECT repo, {basis('all_')} AS basis FROM {every}")
    add(
        "rvj_weaknesses",
        lambda a: review.weaknesses(a.findings, a.surfaces),
        f"SELECT repo, rn::INTEGER AS place, title, severity, confidence, basis, evidence, {acts} AS mitigation FROM (SELECT *, {PLACED} AS rn FROM {of_basis}) WHERE rn <= 8",
    )
    add(
        "rvj_recommendations",
        lambda a: review.recommendations(a.findings, a.surfaces),
        f"SELECT repo, rn::INTEGER AS place, severity AS priority, basis, action, title AS finding FROM (SELECT *, {PLACED} AS rn FROM (SELECT *, {acts}"
        f" AS action, row_number() OVER (PARTITION BY repo, {acts} ORDER BY {rank('severity', threats.SEVERITIES)}, title, rule) AS first FROM {of_basis})"
        f" WHERE first = 1) WHERE rn <= 8",
    )
    risk = rank("risk", surfaces.RISKS)
    add(
        "rvj_hotspots",
        lambda a: review.hotspots(a.surfaces),
        f"SELECT repo, rn::INTEGER AS place, method, route, file, category, risk, exposure, class FROM (SELECT *, row_number() OVER (PARTITION BY repo"
        f" ORDER BY {risk}, exposure <> 'public', route, seq) AS rn FROM {classed} s WHERE NOT {low('file')} OR NOT EXISTS (SELECT 1 FROM surf t"
        f" WHERE t.repo = s.repo AND NOT {low('t.file')})) WHERE rn <= 6",
    )
    said = "lower(array_to_string(steps, ' '))"
    add(
        "rvj_evidence_chains",
        lambda a: review.evidence_chains(a.paths).withColumn("steps", F.array_join("steps", " | ")),
        f"SELECT repo, place, name, CASE WHEN contains({said}, 'entry:') AND contains({said}, 'confidence=') THEN 'observed_plus_inferred' WHEN contains({said},"
        f" 'entry:') THEN 'observed' ELSE 'inferred' END AS basis, array_to_string(steps[:8], ' | ') AS steps FROM path WHERE place <= 6",
    )
    few = lambda source, order, value, n: (
        f"SELECT repo, string_agg(v, ' | ' ORDER BY rn) AS evidence FROM (SELECT repo, {value} AS v, row_number() OVER (PARTITION BY repo ORDER BY {order})"
        f" AS rn FROM {source}) WHERE rn <= {n} GROUP BY repo"
    )
    parts = {
        "auth": (1, "observed", few("(SELECT DISTINCT repo, hint FROM clean WHERE family = 'auth')", "hint", "hint", 8)),
        "internal": (2, "inferred", few("(SELECT * FROM surf WHERE exposure = 'internal')", "seq", f"method || ' ' || route || ' (' || {place()} || ')'", 6)),
        "secret": (3, "observed", few("secret_hint", "seq", "name || ' (' || file || ')'", 8)),
    }
    strong = " UNION ALL ".join(f"SELECT repo, {i} AS place, {q(review.SAID[k])} AS statement, '{b}' AS basis, evidence FROM ({sql})" for k, (i, b, sql) in parts.items())
    add(
        "rvj_strengths",
        lambda a: review.strengths(a.clean, a.surfaces),
        f"{strong} UNION ALL SELECT repo, 1, {q(review.SAID['none'])}, 'inferred', '' FROM repo WHERE repo NOT IN (SELECT repo FROM ({strong}))",
    )
    has = lambda marks: f"bool_or({any_of('w', marks)})"
    add(
        "ctx_domain_hints",
        lambda a: review.domain_hints(a.clean).select("repo", F.array_join("tags", ",").alias("tags")),
        f"SELECT repo, CASE WHEN a OR b OR l THEN concat_ws(',', CASE WHEN a THEN 'atproto' END, CASE WHEN b THEN 'bluesky' END, CASE WHEN l THEN 'laminas' END)"
        f" ELSE 'general' END AS tags FROM (SELECT r.repo, {has(review.ATPROTO_MARKS + review.BLUESKY_MARKS)} AS a, {has(review.BLUESKY_MARKS)} AS b,"
        f" {has(review.LAMINAS_MARKS)} AS l"
        " FROM repo r LEFT JOIN (SELECT repo, lower(path || ' ' || file) AS w FROM route UNION ALL SELECT repo, lower(hint) FROM clean WHERE family = 'auth') x ON x.repo = r.repo GROUP BY r.repo)",
    )
    n = lambda name, table, more="": f"'{name}=' || (SELECT count(*) FROM {table} x WHERE x.repo = r.repo{more})"
    files = " UNION ALL ".join(f"SELECT repo, file FROM {t}" for t in ("route", "external_call", "database_hint", "clean", "secret_hint"))
    add(
        "prm_repo_context",
        lambda a: review.repo_context(a.clean),
        f"SELECT repo, concat_ws('; ', 'root=' || repo, 'files_scanned=' || (SELECT count(DISTINCT file) FROM ({files}) x WHERE x.repo = r.repo),"
        f" {n('routes', 'route')}, {n('external_calls', 'external_call')}, 'datastores=' || coalesce((SELECT string_agg(kind, ', ' ORDER BY kind)"
        f" FROM (SELECT DISTINCT repo, kind FROM database_hint) x WHERE x.repo = r.repo), 'none'), "
        + n("auth_hints", "clean", " AND x.family = 'auth'") + ", " + n("secret_hints", "secret_hint") + ") AS context FROM repo r",
    )
    kept = ", ".join(f"count(*) FILTER (WHERE class = '{k}') AS {k}" for k in CLASSES if k != "inferred")
    add(
        "prm_evidence_counts",
        lambda a: review.prompt_counts(a.surfaces),
        f"SELECT repo, {kept} FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS rn FROM {classed}) WHERE rn <= 50 GROUP BY repo",
    )
    documents(add)


#: Sections of the review, each with the columns that the query shows, and of the prompt's evidence.
SECTIONS = {
    "surfaces": ("method", "route", "file", "category", "exposure", "risk", "evidence_class"),
    "strengths": ("statement", "basis", "evidence"),
    "weaknesses": ("title", "severity", "confidence", "basis", "evidence", "mitigation"),
    "risk_hotspots": ("method", "route", "file", "category", "risk", "exposure", "class"),
    "evidence_chains": ("name", "basis"),
    "recommendations": ("priority", "basis", "action", "finding"),
}
PACKED = {
    "attack_paths": ("id", "name"),
    "attack_surfaces": ("id", "method", "route", "file", "category", "exposure", "risk", "evidence_class"),
    "findings": ("id", "title", "severity", "confidence", "evidence", "mitigation"),
}


def opened(df: DataFrame, column: str, sections: dict[str, tuple[str, ...]]) -> DataFrame:
    """repo, section, place, line of a JSON document's sections: its values, read back from the text."""
    df = settled(df.select("repo", column), "opened")  # each section reads it
    rows = []
    for name, columns in sections.items():
        kind = "struct<" + ", ".join(f"`{name}`: array<struct<{', '.join(f'{k}: string' for k in columns)}>>" for name, columns in ((name, columns),)) + ">"
        each = df.select("repo", F.posexplode(F.from_json(column, kind)[name]).alias("place", "x"))
        rows.append(each.select("repo", F.lit(name).alias("section"), F.col("place"), F.concat_ws(" | ", *(F.coalesce(F.col("x")[k], F.lit("-")) for k in columns)).alias("line")))
    return reduce(DataFrame.unionByName, rows)


def opened_sql(sections: dict[str, tuple[str, ...]], sources: dict[str, str]) -> str:
    parts = []
    for name, columns in sections.items():
        line = " || ' | ' || ".join(f"coalesce(({k})::VARCHAR, '-')" for k in columns)
        parts.append(f"SELECT repo, '{name}' AS section, (row_number() OVER (PARTITION BY repo ORDER BY place) - 1)::INTEGER AS place, {line} AS line FROM ({sources[name]})")
    return " UNION ALL ".join(parts)


def documents(add: Callable) -> None:
    """The documents, read back from their JSON, against the views in SQL."""
    acts = mapped("rule", review.MITIGATIONS)
    by = rank("severity", threats.SEVERITIES)
    view = VIEWS.__getitem__
    few = lambda n: f"SELECT *, class AS evidence_class, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS rn FROM classed) WHERE rn <= {n}"
    sources = {
        "surfaces": few(review.SHOWN["surfaces"]),
        "strengths": view("rvj_strengths"),
        "weaknesses": view("rvj_weaknesses"),
        "risk_hotspots": view("rvj_hotspots"),
        "evidence_chains": view("rvj_evidence_chains"),
        "recommendations": view("rvj_recommendations"),
    }
    built = lambda a: review.review_json(a.clean, a.surfaces, a.findings, a.paths)
    add("rvj_build", lambda a: opened(built(a), "review", SECTIONS), opened_sql(SECTIONS, sources))
    said = {k: f"$.{p}" for k, p in (("artifact", "artifact_type"), ("version", "schema_version"), ("root", "review.root"), ("segment", "source_quality_rules.low_quality_path_segments[4]"), ("limits", "limitations[0]"), ("tags", "domain_hints"))}
    tagged = VIEWS["ctx_domain_hints"]
    pack = lambda a: review.context_pack(a.clean, built(a))
    add(
        "ctx_build",
        lambda a: pack(a).select("repo", *(F.get_json_object("pack", p).alias(k) for k, p in said.items())),
        f"SELECT r.repo, 'review_context_pack' AS artifact, {q(review.PACK_VERSION)} AS version, r.repo AS root, '/examples/' AS segment,"
        f" {q(review.LIMITATIONS[0])} AS limits, '[\"' || replace(tags, ',', '\",\"') || '\"]' AS tags FROM repo r JOIN ({tagged}) t USING (repo)",
    )
    placed = (
        f"SELECT *, 'finding:' || place AS id, {acts} AS mitigation FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {by}, title, rule) AS place"
        f" FROM finding) WHERE place <= {review.PROMPT_SHOWN['findings']}"
    )
    shown = {
        "attack_paths": f"SELECT *, 'path:' || place AS id FROM path WHERE place <= {review.PROMPT_SHOWN['paths']}",
        "attack_surfaces": f"SELECT *, 'surface:' || place AS id FROM ({few(review.PROMPT_SHOWN['surfaces'])})",
        "findings": placed,
    }
    evidence = lambda a: review.evidence_pack(a.clean, a.surfaces, a.findings, a.paths)
    add("prm_evidence_pack", lambda a: opened(evidence(a), "evidence", PACKED), opened_sql(PACKED, shown))
    ids = " + ".join(f"(SELECT count(*) FROM ({s}) x WHERE x.repo = r.repo)" for s in shown.values())
    add(
        "prm_render",
        lambda a: review.prompts(evidence(a)).select("repo", "system", F.substring_index("user", "\n", 1).alias("first"), F.regexp_count("user", F.lit('"id":"(path|surface|finding):[0-9]+"')).cast("long").alias("n_ids")),
        f"SELECT r.repo, {q(review.SYSTEM)} AS system, 'Repository: ' || context AS first, {ids} AS n_ids FROM repo r JOIN ({VIEWS['prm_repo_context']}) c USING (repo)",
    )
