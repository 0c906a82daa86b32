"""Registered queries of the markdown reports, line by line, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from factloom.operators import markdown, review, threats
from factloom.operators.markdown import SHOWN
from factloom.plans.oracles import LIBRARY, even, low, q, rank

BY_SEVERITY = rank("severity", threats.SEVERITIES)
BY_RISK = rank("risk", ("high", "medium", "low"))


def mapped(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + " END"


def one(x: str) -> str:
    return f"printf('%.1f', {even(x, 1)})"


def cut(source: str, order: str, n: int, keys: str = "repo") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) WHERE rn <= {n})"


def several(source: str, place: str, *lines: str) -> str:
    return " UNION ALL ".join(f"SELECT repo, {place} * 10 + {i} AS place, {x} AS line FROM {source}" for i, x in enumerate(lines))


def part(heading: str, i: int, lines: str, default: str | None = None, always: bool = True) -> str:
    """A part's lines: its heading for every repository (or only where it has lines), its rows, and what stands for none."""
    head = f"SELECT repo, {i} AS part, -1 AS place, {q(heading)} AS line FROM repo" + ("" if always else f" WHERE repo IN (SELECT repo FROM ({lines}))")
    rows = f"SELECT repo, {i}, place, line FROM ({lines})"
    none = f"SELECT repo, {i}, 0, {q(default or '')} FROM repo WHERE repo NOT IN (SELECT repo FROM ({lines}))"
    return " UNION ALL ".join([head, rows, *([none] if default else [])])


def notes(headings: tuple[str, ...]) -> str:
    i = len(headings) - 1
    return f"SELECT repo, {i}, x.p, x.l FROM (SELECT repo, unnest([{{p: -1, l: {q(headings[i])}}}, {', '.join(f'{{p: {j}, l: {q(x)}}}' for j, x in enumerate(markdown.NOTES))}]) AS x FROM repo)"


def counts(of: dict[str, str]) -> str:
    return ", ".join(f"(SELECT count(*) FROM {t} x WHERE x.repo = r.repo) AS {k}" for k, t in of.items())


def words(hints: str) -> str:
    text = lambda column, table: f"coalesce((SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {column} AS v FROM {table} x WHERE x.repo = r.repo)), 'none')"
    return f"{text('kind', 'database_hint')} AS stores, {text('target', 'external_call')} AS targets, {text('hint', '(SELECT * FROM ' + hints + chr(32) + 'WHERE family = ' + q('auth') + ')')} AS auth"


def architecture_sql() -> str:
    h = markdown.ARCHITECTURE
    told = f"(SELECT repo, {counts({'routes': 'route', 'secrets': 'secret_hint'})}, {words('hint')} FROM repo r)"
    shape = "CASE WHEN routes > 0 THEN 'web-facing' ELSE 'non-web' END"
    overview = several(
        told,
        "0",
        f"'- A ' || {shape} || ' repository with ' || routes || ' entry point(s).'",
        "'- Files scanned: 0'",
        "'- Languages: none'",
        "'- Datastores: ' || stores",
        "'- External targets: ' || targets",
        "'- Auth hints: ' || auth",
        "'- Secret-like names read from the environment: ' || secrets",
    )
    files = cut("(SELECT repo, file, count(*) AS n, min(seq) AS s FROM route GROUP BY ALL)", "n DESC, s", 3)
    edges = """(SELECT DISTINCT repo, 'repo -> web (contains)' AS e FROM route UNION ALL SELECT DISTINCT repo, 'repo -> db_' || kind || ' (uses)' FROM database_hint
      UNION ALL SELECT repo, 'repo -> external_' || row_number() OVER (PARTITION BY repo ORDER BY seq) || ' (calls)' FROM external_call)"""
    parts = [
        f"SELECT repo, 0 AS part, -1 AS place, {q(h[0])} AS line FROM repo",
        part(h[1], 1, overview),
        part(h[2], 2, f"SELECT repo, rn AS place, '- ' || file || ': ' || n || ' routes' AS line FROM {files}", always=False),
        part(h[3], 3, f"SELECT repo, 0 AS place, '- Begin with `' || file || '`, which holds ' || n || ' of the routes.' AS line FROM {files} WHERE rn = 1", always=False),
        part(h[4], 4, f"SELECT repo, rn AS place, '- ' || e AS line FROM {cut(edges, 'e', SHOWN['edges'])}", always=False),
        notes(h),
    ]
    return "SELECT repo, part, place::INTEGER AS place, line FROM (" + " UNION ALL ".join(parts) + ")"


def surface_sql() -> str:
    h, n = markdown.SURFACE, SHOWN["routes"]
    traits = (
        "CASE WHEN len(auth_signals) > 0 THEN 'auth signals: ' || array_to_string(auth_signals, ', ') ELSE 'no auth signals observed' END || CASE"
        " WHEN data_store THEN '; data store reachable' ELSE '' END || CASE WHEN outbound THEN '; external trust boundary' ELSE '' END"
    )
    where = "method || ' ' || route || ' (' || file || ') -> ' || category"
    full = f"'- [' || upper(risk) || '] ' || {where} || ', ' || exposure || '; ' || {traits}"
    listed = lambda on, line=full: f"SELECT repo, rn AS place, {line} AS line FROM {cut(f'(SELECT * FROM surf WHERE {on})', f'{BY_RISK}, route, method, seq', n)}"
    view = {
        "high": "(SELECT * FROM surf WHERE risk = 'high')",
        "public": "(SELECT * FROM surf WHERE exposure = 'public')",
        "internal": "(SELECT * FROM surf WHERE exposure = 'internal')",
        "data": "(SELECT * FROM surf WHERE data_store)",
        "out": "(SELECT * FROM surf WHERE outbound)",
    }
    priority = several(
        f"(SELECT repo, {counts(view)} FROM repo r)",
        "0",
        "'- High-risk entry points: ' || high",
        "'- Public routes: ' || public",
        "'- Internal routes: ' || internal",
        "'- Routes with data access: ' || data",
        "'- Routes with outbound calls: ' || out",
    )
    targets = f"SELECT repo, rn AS place, '- ' || target AS line FROM {cut('(SELECT DISTINCT repo, target FROM external_call)', 'target', SHOWN['targets'])}"
    secrets = f"""SELECT repo, rn AS place, '- Secret read from the environment: ' || name || ' (' || file || ')' AS line FROM {cut("secret_hint", "seq", SHOWN["targets"])}
      UNION ALL SELECT repo, 0, '- No secret-like names are read from the environment' FROM repo WHERE repo NOT IN (SELECT repo FROM secret_hint)
      UNION ALL SELECT repo, 1000, CASE WHEN auth = 'none' THEN '- No auth hints' ELSE '- Auth hints: ' || auth END FROM (SELECT repo, {words("clean")} FROM repo r)"""
    parts = [
        f"SELECT repo, 0 AS part, -1 AS place, {q(h[0])} AS line FROM repo",
        part(h[1], 1, priority),
        part(h[2], 2, listed("risk = 'high'", f"'- ' || {where} || '; ' || {traits}"), "- None is of high risk"),
        part(h[3], 3, listed("category IN ('auth', 'admin')"), "- None is for authentication or administration"),
        part(h[4], 4, listed("exposure = 'public' AND category NOT IN ('auth', 'admin', 'health')"), "- There are no other public routes"),
        part(h[5], 5, listed("category IN ('health', 'internal')"), "- None is operational or internal"),
        part(h[6], 6, targets, "- No literal outbound targets"),
        part(h[7], 7, secrets),
    ]
    return "SELECT repo, part, place::INTEGER AS place, line FROM (" + " UNION ALL ".join(parts) + ")"


def strengths_sql() -> str:
    auth = "(SELECT DISTINCT repo, hint FROM clean WHERE family = 'auth')"
    few = (
        f"(SELECT repo, string_agg(hint, ', ' ORDER BY hint) AS hints, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY hint) AS rn,"
        f" count(*) OVER (PARTITION BY repo) AS n FROM {auth}) WHERE rn <= 6 GROUP BY repo)"
    )
    of = lambda on: f"(SELECT repo, count(*) AS n FROM surf WHERE {on} GROUP BY repo)"
    items = [
        f"SELECT repo, 9.0::DOUBLE + least(n, 5) AS score, 0 AS o, '- Signals of authentication or identity are in the code (' || hints || ').' AS line FROM {few}",
        f"SELECT repo, 8.0::DOUBLE + least(n, 5), 1, '- ' || n || ' route(s) have auth signals nearby.' FROM {of('len(auth_signals) > 0')}",
        f"SELECT repo, 7.0::DOUBLE, 2, '- ' || n || ' route(s) look internal, which limits exposure if they are kept apart.' FROM {of(chr(101) + 'xposure = ' + q('internal'))}",
        f"SELECT repo, 6.0::DOUBLE, 3, '- ' || n || ' route(s) are operational and of low risk.' FROM {of('risk = ' + q('low'))}",
        "SELECT DISTINCT repo, 6.5::DOUBLE, 4, '- Secrets come from the environment, not from literals.' FROM secret_hint",
        "SELECT repo, 5.0::DOUBLE, 4, '- No secret-like names are read from the environment.' FROM repo WHERE repo NOT IN (SELECT repo FROM secret_hint)",
    ]
    return f"SELECT repo, (rn - 1)::INTEGER AS place, line FROM {cut('(' + ' UNION ALL '.join(items) + ')', 'score DESC, o', SHOWN['strengths'])}"


def register(add: Callable, class_sql: str, surface_factors: str, path_factors: str) -> None:
    """Adds the queries; class_sql is the SQL of a surface's provenance, the others lists of its and a path's factors."""
    add("arch_report", lambda a: markdown.architecture(a.scan), architecture_sql())
    add("surface_report", lambda a: markdown.attack_surface(a.clean, a.surfaces), surface_sql())
    add("rnk_strengths", lambda a: markdown.strengths(a.clean, a.surfaces), strengths_sql())
    sources = ("observed_runtime", "protocol_derived", "low_quality")
    count = ", ".join(f"count(*) FILTER (WHERE {class_sql} = '{k}') AS {k}" for k in sources)
    LIBRARY["related_sources"] = f"SELECT repo, rule, count(*) AS n, {count} FROM related GROUP BY repo, rule"
    total = "greatest(observed_runtime + protocol_derived + low_quality, 1)"
    label = (
        f"CASE WHEN r.n IS NULL THEN 'inferred-weak' WHEN observed_runtime / {total} * 100 >= 50 THEN 'observed'"
        f" WHEN protocol_derived / {total} * 100 >= 50 THEN 'inferred-protocol' WHEN low_quality / {total} * 100 >= 50 THEN 'low-quality-evidence'"
        f" ELSE 'mixed-evidence' END"
    )
    percent = " || ', ' || ".join(f"'{k}=' || coalesce(round_even({k} / r.n * 100, 0)::INTEGER, 0) || '%'" for k in sources)
    LIBRARY["labelled"] = (
        f"SELECT s.repo, s.rule, s.title, f.severity, s.factors, s.score, {label} AS label, {percent} AS provenance, {mapped('s.rule', review.MITIGATIONS)}"
        f" AS action FROM (SELECT *, {even('list_sum(list_transform(factors, lambda x: x.value))', 2)} AS score FROM scored) s JOIN finding f USING (repo, rule)"
        f" LEFT JOIN related_sources r USING (repo, rule)"
    )
    top = lambda factors, n: (
        f"array_to_string(list_transform(list_filter(list_slice(list_sort(list_transform(list_zip({factors}, range(1, len({factors}) + 1)),"
        f" lambda z: struct_pack(down := -z[1].value, i := z[2], name := z[1].name))), 1, {n}), lambda x: x.down < 0),"
        f" lambda x: x.name || '=' || {one('-x.down')}), ', ')"
    )
    first = cut("labelled", f"score DESC, {BY_SEVERITY}, title, rule", SHOWN["findings"])
    said = several(first, "rn", f"'- [' || upper(severity) || ' | score ' || {one('score')} || '] ' || title", f"'- Reason: ' || {top('factors', 3)}", "'- Provenance: ' || provenance")
    pool = (
        f"(SELECT *, {class_sql} AS source, {surface_factors} AS factors, {even(f'list_sum(list_transform({surface_factors}, lambda x: x.value))', 2)} AS score"
        f" FROM surf s WHERE NOT {low('s.file')} OR NOT EXISTS (SELECT 1 FROM surf t WHERE t.repo = s.repo AND NOT {low('t.file')}))"
    )
    order = f"score DESC, {BY_RISK}, route DESC, seq"
    distinct = f"(SELECT * EXCLUDE (rn) FROM {cut(pool, order, 1, 'repo, route, file, category, exposure')})"
    place = "(file || CASE WHEN line IS NULL THEN '' ELSE ':' || line END)"
    own = " || ', ' || ".join(f"'{k}=' || CASE WHEN source = '{k}' THEN 100 ELSE 0 END || '%'" for k in sources)
    spots = several(
        cut(distinct, order, SHOWN["hotspots"]),
        "(rn + 100)",
        f"'- Hotspot [score ' || {one('score')} || ']: ' || method || ' ' || route || ' (' || {place} || ') -> ' || category || ' / ' || risk",
        f"'- Reason: ' || {top('factors', 2)}",
        f"'- Provenance: ' || {own}",
    )
    add("rnk_weaknesses", lambda a: markdown.weaknesses(a.scored_findings, a.surfaces), f"SELECT repo, rn::INTEGER AS place, line FROM {cut(f'({said} UNION ALL {spots})', 'place', SHOWN['lines'])}")
    LIBRARY["path_scored"] = (
        f"SELECT *, {even('list_sum(list_transform(factors, lambda x: x.value))', 2)} AS score FROM (SELECT *, {path_factors} AS factors FROM (SELECT *,"
        f" lower(name || ' ' || array_to_string(steps, ' ')) AS said FROM path))"
    )
    chains = cut("(SELECT *, place AS given FROM path_scored)", "score DESC, given", SHOWN["chains"])
    lines = several(chains, "rn", f"'- [score ' || {one('score')} || '] ' || name || ': ' || {mapped('kind', threats.IMPACTS)}", f"'- Reason: ' || {top('factors', 3)}", "'- Key step: ' || steps[1]")
    add("rnk_evidence_chains", lambda a: markdown.evidence_chains(a.paths), f"SELECT repo, place::INTEGER AS place, line FROM ({lines})")
    weak = "label = 'low-quality-evidence'"
    acts = f"(SELECT *, '- [' || label || '] ' || action AS line FROM labelled WHERE action IS NOT NULL)"  # noqa: F541
    ranked = f"{weak}, score DESC, {BY_SEVERITY}, title, rule"
    few = cut(f"(SELECT * EXCLUDE (rn) FROM {cut(acts, ranked, 1, 'repo, line')})", ranked, SHOWN["actions"])
    rows = (
        f"(SELECT repo, rn AS p, line FROM {few} UNION ALL SELECT DISTINCT repo, 5, {q(markdown.HOPS)} FROM path_scored"
        f" WHERE score >= {markdown.STRONG_PATH}::DOUBLE UNION ALL SELECT repo, 6, {q(markdown.TESTS)} FROM repo)"
    )
    add("rnk_recommendations", lambda a: markdown.recommendations(a.clean, a.scored_findings, a.paths), f"SELECT repo, rn::INTEGER AS place, line FROM {cut(rows, 'p', SHOWN['all_actions'])}")
    # The whole review: how many lines each part has, and the length of the lists that are cut.
    capped = lambda table, n, per, where="true": f"SELECT repo, least(count(*), {n}) * {per} + CASE WHEN count(*) > {n} THEN 1 ELSE 0 END AS n FROM {table} WHERE {where} GROUP BY repo"
    sizes = {
        "Asset Inventory": capped("asset", SHOWN["assets"], 1),
        "ATT&CK Techniques Mapped": (
            "SELECT repo, count(DISTINCT t) AS n FROM (SELECT repo, unnest(techniques) AS t FROM ins_tech UNION ALL SELECT repo, unnest(techniques) FROM fnd_tech)"
            " GROUP BY repo"
        ),
        "Strengths": f"SELECT repo, count(*) AS n FROM ({strengths_sql()}) GROUP BY repo",
    }
    numbers = {"Asset Inventory": 5, "ATT&CK Techniques Mapped": 3, "Strengths": 7}
    sql = " UNION ALL ".join(f"SELECT r.repo, {numbers[k]} AS part, coalesce(x.n, 1) AS n FROM repo r LEFT JOIN ({s}) x USING (repo)" for k, s in sizes.items())
    fixed = " UNION ALL ".join(f"SELECT repo, {i}, {n} FROM repo" for i, n in ((1, 6), (11, len(markdown.NOTES))))

    def sizes_of(a):
        lines = markdown.review(a.clean, a.surfaces, a.findings, a.paths, a.overlay).where(F.col("place") >= 0)
        return lines.where(F.col("part").isin(1, 3, 5, 7, 11)).groupBy("repo", "part").agg(F.count("*").alias("n"))

    add("rnk_render", sizes_of, f"SELECT repo, part::INTEGER AS part, n::BIGINT AS n FROM ({sql} UNION ALL {fixed})")
