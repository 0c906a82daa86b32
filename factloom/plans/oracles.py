"""Oracles: every registered relation once more, written directly in SQL over the test tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import insights, overlay, signals, surfaces, threats
from factloom.sources.adapters import oracle_ctes


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(p)})" for p in parts) + ")"


def wrap(file: str) -> str:
    return f"('/' || lower(replace({file}, '\\', '/')) || '/')"


def low(file: str) -> str:
    return any_of(wrap(file), ("/tests/", "/__tests__/", "/fixtures/", "/mocks/", "/examples/"))


def low_ext(file: str) -> str:
    return any_of(wrap(file), ("/tests/", "/__tests__/", "/fixtures/", "/mocks/", "/examples/", "/test_", "/_test."))


def place(alias: str = "") -> str:
    return f"({alias}file || CASE WHEN {alias}line IS NULL THEN '' ELSE ':' || {alias}line END)"


def module(file: str) -> str:
    return f"regexp_replace({file}, '/[^/]*$', '')"


def isin(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(map(q, values))})"


def rank(column: str, order: tuple[str, ...]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {q(x)} THEN {i}" for i, x in enumerate(order)) + " ELSE 9 END"


def even(x: str, digits: int) -> str:
    """x rounded to digits, halves to even, by whole millionths, so that binary noise doesn't decide."""
    unit, m = 10 ** (6 - digits), f"round(({x}) * 1000000)::BIGINT"
    up = f"abs({m}) % {unit} > {unit // 2} OR (abs({m}) % {unit} = {unit // 2} AND (abs({m}) // {unit}) % 2 = 1)"
    return f"(sign({m}) * (abs({m}) // {unit} + CASE WHEN {up} THEN 1 ELSE 0 END) / {10**digits}.0::DOUBLE)"


def top(source: str, keys: str, order: str, value: str, n: int, name: str = "evidence") -> str:
    return (
        f"SELECT {keys}, string_agg(v, ' | ' ORDER BY rn) AS {name} FROM (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {order})"
        f" AS rn FROM {source}) WHERE rn <= {n} GROUP BY {keys}"
    )


def category(path: str) -> str:
    cases = " ".join(f"WHEN {any_of(f'lower({path})', parts)} THEN {q(name)}" for name, parts in surfaces.CATEGORIES)
    return f"CASE {cases} ELSE 'public_api' END"


def surface(hints: str) -> str:
    why = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in surfaces.WHY.items())
    return f"""
  SELECT repo, path AS route, method, file, line,
    CASE WHEN inward AND first = 'public_api' THEN 'internal' ELSE first END AS category,
    CASE WHEN inward OR first = 'internal' THEN 'internal' ELSE 'public' END AS exposure,
    CASE WHEN inward THEN CASE WHEN first = 'health' THEN 'low' ELSE 'medium' END
      WHEN first IN ('webhook', 'admin', 'upload') THEN 'high' WHEN first = 'auth' THEN CASE WHEN len(auth) > 0 THEN 'medium' ELSE 'high' END
      WHEN first = 'internal' THEN 'medium' WHEN first = 'health' THEN 'low' WHEN db OR call THEN 'medium' ELSE 'low' END AS risk,
    auth AS auth_signals, db AS data_store, call AS outbound,
    concat_ws(' ', CASE first {why} END, CASE WHEN inward THEN 'Handler metadata says that the route faces inward.' END,
      CASE WHEN len(auth) > 0 THEN 'Auth indicators: ' || array_to_string(auth, ', ') || '.' ELSE 'No auth indicators near this route.' END,
      CASE WHEN db THEN 'A datastore is used in the repository.' END, CASE WHEN call THEN 'Outbound calls are made in the repository.' END) AS rationale, seq
  FROM (
    SELECT *, list_has_any(supporting, [{', '.join(map(q, surfaces.INTERNAL_HANDLERS))}]) AND NOT list_contains(supporting, 'handler_visibility:public') AND first NOT IN ('admin', 'auth', 'webhook') AS inward
    FROM (
      SELECT r.*, {category('r.path')} AS first, coalesce(fa.h, ra.h, []) AS auth, coalesce(fs.h, rs.h, []) AS supporting,
        EXISTS (SELECT 1 FROM database_hint d WHERE d.repo = r.repo) AS db, EXISTS (SELECT 1 FROM external_call c WHERE c.repo = r.repo) AS call
      FROM route r
      LEFT JOIN (SELECT repo, file, list_sort(list(DISTINCT hint)) AS h FROM {hints} WHERE family = 'auth' GROUP BY ALL) fa ON fa.repo = r.repo AND fa.file = r.file
      LEFT JOIN (SELECT repo, list_sort(list(DISTINCT hint)) AS h FROM {hints} WHERE family = 'auth' GROUP BY ALL) ra ON ra.repo = r.repo
      LEFT JOIN (SELECT repo, file, list_sort(list(DISTINCT hint)) AS h FROM {hints} GROUP BY ALL) fs ON fs.repo = r.repo AND fs.file = r.file
      LEFT JOIN (SELECT repo, list_sort(list(DISTINCT hint)) AS h FROM {hints} GROUP BY ALL) rs ON rs.repo = r.repo))"""


AUTH_LIKE = (
    f"CASE WHEN starts_with(lower(hint), 'atproto_auth:') THEN true"
    f" WHEN {' OR '.join(f'starts_with(lower(hint), {q(p)})' for p in signals.NOT_AUTH)} THEN false ELSE regexp_matches(lower(hint),"
    f" {q(signals.AUTH_WORDS)}) END"
)
EVIDENCE = (
    "(method || ' ' || route || ' in ' || file || CASE WHEN len(auth_signals) > 0 THEN '; auth signals: ' || array_to_string(auth_signals, ', ')"
    " ELSE '; no auth signals observed' END || CASE WHEN data_store THEN '; data store reachable' ELSE '' END || CASE"
    " WHEN outbound THEN '; external integration reachable' ELSE '' END)"
)
SENSITIVE = f"(criticality IN ('critical', 'high') OR {isin('kind', overlay.SENSITIVE)})"


def prefixed(prefix: str) -> str:
    other = next((f for p, f in signals.PREFIX_FAMILY if prefix.startswith(p)), "auth")
    return (
        f"SELECT repo, substr(hint, {len(prefix) + 1}) AS value, file, min((CASE family WHEN 'auth' THEN 0 ELSE 1 END, seq)) AS o FROM hint"
        f" WHERE starts_with(hint, {q(prefix)}) AND family IN ('auth', {q(other)}) GROUP BY repo, value, file"
    )


def service_of(file: str) -> str:
    parts = f"string_split({file}, '/')"
    return "coalesce(" + ", ".join(f"CASE WHEN list_contains({parts}, {q(p)}) THEN lower({parts}[list_position({parts}, {q(p)}) + 1]) END" for p in ("services", "packages", "apps")) + ")"


def module_key(file: str) -> str:
    return f"CASE WHEN regexp_extract({file}, '/module/([^/]+)', 1) <> '' THEN 'module/' || lower(regexp_extract({file}, '/module/([^/]+)', 1)) ELSE lower(string_split({file}, '/')[1]) END"


def sink_ctes(tag: str, services: str) -> dict[str, str]:
    return {
        f"db_{tag}": f"SELECT d.repo, s.service, arg_min(d.kind || ' (' || d.file || ')', d.seq) AS db FROM database_hint d JOIN {services} s ON s.repo = d.repo AND s.file = d.file GROUP BY ALL",
        f"out_{tag}": (
            f"SELECT d.repo, s.service, arg_min(d.target || ' (' || d.file || ')', d.seq) AS out FROM external_call d JOIN {services} s ON s.repo = d.repo"
            f" AND s.file = d.file WHERE NOT starts_with(d.target, 'env://') GROUP BY ALL"
        ),
        f"env_{tag}": (
            f"SELECT d.repo, s.service, arg_min(d.target, d.seq) AS env_risk FROM external_call d JOIN {services} s ON s.repo = d.repo AND s.file = d.file"
            f" WHERE starts_with(d.target, 'env://') GROUP BY ALL"
        ),
    }


ELSEWHERE = "WHEN any_db IS NOT NULL THEN 'database hint elsewhere in repo: ' || any_db WHEN any_call IS NOT NULL THEN 'external call elsewhere in repo: ' || any_call"
RUNTIME = f"(SELECT * FROM route WHERE NOT {low('file')})"


def chain_ctes() -> dict[str, str]:
    out = {
        "edge": (
            "SELECT repo, lower(trim(string_split(substr(hint, 6), '->')[1])) AS source, lower(trim(substr(hint, 6 + position('->' IN substr(hint, 6)) + 1)))"
            " AS target, file, CASE family WHEN 'edge' THEN 0 ELSE 1 END AS ord, seq FROM hint WHERE family IN ('edge', 'auth') AND starts_with(hint, 'edge:')"
            " AND contains(substr(hint, 6), '->')"
        ),
        "edge1": "SELECT repo, source, arg_min(target, (ord, seq)) AS target FROM edge WHERE source <> '' AND target <> '' GROUP BY ALL",
        "named": f"SELECT repo, file, arg_max(lower(value), o) AS service FROM ({prefixed('service_name:')}) GROUP BY ALL",
        "files": "SELECT repo, file FROM named UNION SELECT repo, file FROM route UNION SELECT repo, file FROM database_hint UNION SELECT repo, file FROM external_call",
        "services": (
            f"SELECT * FROM (SELECT f.repo, f.file, coalesce(n.service, {service_of('f.file')}) AS service FROM files f LEFT JOIN named n ON n.repo = f.repo"
            f" AND n.file = f.file) WHERE service IS NOT NULL"
        ),
        "noted": f"SELECT repo, file, arg_min(lower(value), o) AS note FROM ({prefixed('atproto_service_note:')}) GROUP BY ALL",
        "services_noted": (
            f"SELECT * FROM (SELECT coalesce(x.repo, n.repo) AS repo, coalesce(x.file, n.file) AS file, coalesce(x.service, n.note) AS service FROM (SELECT f.repo,"
            f" f.file, coalesce(n.service, {service_of('f.file')}) AS service FROM files f LEFT JOIN named n ON n.repo = f.repo AND n.file = f.file) x FULL"
            f" JOIN noted n ON n.repo = x.repo AND n.file = x.file) WHERE service IS NOT NULL"
        ),
        "anywhere": (
            "SELECT coalesce(d.repo, c.repo) AS repo, any_db, any_call FROM (SELECT repo, arg_min(kind || ' (' || file || ')', seq) AS any_db FROM database_hint"
            " GROUP BY repo) d FULL JOIN (SELECT repo, arg_min(target || ' (' || file || ')', seq) AS any_call FROM external_call"
            " GROUP BY repo) c ON c.repo = d.repo"
        ),
        **sink_ctes("s", "services"),
        **sink_ctes("a", "services_noted"),
    }
    sink = (
        "CASE WHEN db IS NOT NULL THEN 'database' WHEN out IS NOT NULL THEN 'external dependency' WHEN any_db IS NOT NULL THEN 'database'"
        " WHEN any_call IS NOT NULL THEN 'external dependency' ELSE 'privileged downstream action' END"
    )
    out["service_chain"] = f"""
  SELECT repo, method, path, file, entry_service, next_service, {sink} AS sink,
    least(0.35::DOUBLE + CASE WHEN named THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN next_service IS NOT NULL THEN 0.15::DOUBLE ELSE 0::DOUBLE END + CASE WHEN db IS NOT NULL THEN 0.2::DOUBLE WHEN out IS NOT NULL THEN 0.15::DOUBLE WHEN any_db IS NOT NULL OR any_call IS NOT NULL THEN 0.05::DOUBLE ELSE 0::DOUBLE END + CASE WHEN env_risk IS NOT NULL THEN 0.05::DOUBLE ELSE 0::DOUBLE END, 0.95::DOUBLE) AS confidence,
    list_filter(['route ' || method || ' ' || path || ' in ' || file, CASE WHEN named THEN 'entry service from file-local hint: ' ELSE 'entry service inferred from repository layout: ' END || entry_service, CASE WHEN next_service IS NOT NULL THEN 'inter-service edge: ' || entry_service || '->' || next_service END,
      CASE WHEN db IS NOT NULL THEN 'database sink in service ' || service || ': ' || db WHEN out IS NOT NULL THEN 'external sink in service ' || service || ': ' || out {ELSEWHERE} END, CASE WHEN env_risk IS NOT NULL THEN 'env-configured dependency in entry service: ' || env_risk END], lambda x: x IS NOT NULL) AS evidence, env_risk, seq
  FROM (SELECT r.*, e.target AS next_service, coalesce(e.target, r.entry_service) AS service, v.env_risk FROM
    (SELECT r.*, s.service IS NOT NULL AS named, coalesce(s.service, {service_of('r.file')}, 'entry-service') AS entry_service FROM {RUNTIME} r LEFT JOIN services s ON s.repo = r.repo AND s.file = r.file
      WHERE r.repo IN (SELECT repo FROM hint WHERE family IN ('service', 'auth') AND starts_with(hint, 'service_name:') UNION SELECT repo FROM edge WHERE source <> '' AND target <> '')) r
    LEFT JOIN edge1 e ON e.repo = r.repo AND e.source = r.entry_service LEFT JOIN env_s v ON v.repo = r.repo AND v.service = r.entry_service)
  LEFT JOIN db_s USING (repo, service) LEFT JOIN out_s USING (repo, service) LEFT JOIN anywhere USING (repo)"""
    known = lambda prefix, key: f"EXISTS (SELECT 1 FROM ({prefixed(prefix)}) k WHERE k.repo = r.repo AND k.value = r.{key})"
    out["atproto_chain"] = f"""
  SELECT repo, method, path, file, namespace, entry_service, next_service, {sink} AS sink,
    least(0.45::DOUBLE + CASE WHEN in_ns THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN in_lex THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN in_ref THEN 0.05::DOUBLE ELSE 0::DOUBLE END + CASE WHEN named THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END + CASE WHEN edge IS NOT NULL THEN 0.1::DOUBLE WHEN env_edge IS NOT NULL THEN 0.05::DOUBLE ELSE 0::DOUBLE END
      + CASE WHEN db IS NOT NULL THEN 0.15::DOUBLE WHEN out IS NOT NULL THEN 0.12::DOUBLE WHEN any_db IS NOT NULL OR any_call IS NOT NULL THEN 0.03::DOUBLE ELSE 0::DOUBLE END + CASE WHEN env_risk IS NOT NULL THEN 0.04::DOUBLE ELSE 0::DOUBLE END + CASE WHEN streams IS NOT NULL THEN 0.03::DOUBLE ELSE 0::DOUBLE END, 0.95::DOUBLE) AS confidence,
    list_filter(['xrpc route ' || method || ' ' || path || ' in ' || file, CASE WHEN in_ns THEN 'namespace signal observed: ' || namespace END, CASE WHEN in_lex THEN 'lexicon-defined endpoint: ' || endpoint END, CASE WHEN in_ref THEN 'code-level xrpc reference: ' || endpoint END,
      CASE WHEN named THEN 'entry service from analyzer hints: ' ELSE 'entry service inferred from repository layout: ' END || entry_service, CASE WHEN edge IS NOT NULL THEN 'inter-service edge: ' || entry_service || '->' || next_service WHEN env_edge IS NOT NULL THEN 'atproto env-derived service edge: ' || entry_service || '->' || next_service END,
      CASE WHEN db IS NOT NULL THEN 'database sink in service ' || service || ': ' || db WHEN out IS NOT NULL THEN 'outbound sink in service ' || service || ': ' || out {ELSEWHERE} END, CASE WHEN env_risk IS NOT NULL THEN 'env-configured dependency in entry service: ' || env_risk END, CASE WHEN streams IS NOT NULL THEN 'event stream exposure hints: ' || streams END], lambda x: x IS NOT NULL) AS evidence, env_risk, seq
  FROM (SELECT r.*, e.target AS edge, f.env_edge, coalesce(e.target, f.env_edge) AS next_service, coalesce(e.target, f.env_edge, r.entry_service) AS service, v.env_risk, t.streams, {known('atproto_namespace:', 'namespace')} AS in_ns, {known('atproto_lexicon:', 'endpoint')} AS in_lex, {known('atproto_xrpc_ref:', 'endpoint')} AS in_ref FROM
    (SELECT r.*, CASE WHEN starts_with(regexp_extract(path, '/xrpc/(.*)', 1), 'com.atproto.') THEN 'com.atproto' WHEN starts_with(regexp_extract(path, '/xrpc/(.*)', 1), 'app.bsky.') THEN 'app.bsky' END AS namespace, regexp_replace(path, '^/xrpc/', '') AS endpoint, s.service IS NOT NULL AS named, coalesce(s.service, {service_of('r.file')}, 'entry-service') AS entry_service
      FROM {RUNTIME} r LEFT JOIN services_noted s ON s.repo = r.repo AND s.file = r.file WHERE r.repo IN (SELECT repo FROM hint WHERE family IN ('protocol', 'auth') AND starts_with(hint, 'atproto_'))) r
    LEFT JOIN edge1 e ON e.repo = r.repo AND e.source = r.entry_service LEFT JOIN env_a v ON v.repo = r.repo AND v.service = r.entry_service
    LEFT JOIN (SELECT repo, min(value) AS env_edge FROM ({prefixed('atproto_service_edge:')}) GROUP BY repo) f ON f.repo = r.repo
    LEFT JOIN (SELECT repo, array_to_string(list_slice(list_sort(list(DISTINCT value)), 1, 2), ', ') AS streams FROM ({prefixed('atproto_event_stream:')}) GROUP BY repo) t ON t.repo = r.repo WHERE namespace IS NOT NULL)
  LEFT JOIN db_a USING (repo, service) LEFT JOIN out_a USING (repo, service) LEFT JOIN anywhere USING (repo)"""
    here = lambda prefix: f"SELECT repo, file, arg_min(value, o) AS v FROM ({prefixed(prefix)}) GROUP BY ALL"
    near = lambda prefix: f"SELECT repo, {module_key('file')} AS module, arg_min(value, o) AS v FROM ({prefixed(prefix)}) GROUP BY ALL"
    out["framework_chain"] = f"""
  SELECT repo, method, path, file, coalesce(ch, cn) AS controller, action, coalesce(sh, sn) AS service, CASE WHEN db IS NOT NULL THEN 'database' WHEN out IS NOT NULL THEN 'external integration' WHEN any_db IS NOT NULL THEN 'database' WHEN any_call IS NOT NULL THEN 'external integration' ELSE 'privileged action' END AS sink,
    least(0.35::DOUBLE + CASE WHEN ch IS NOT NULL THEN 0.25::DOUBLE WHEN cn IS NOT NULL THEN 0.15::DOUBLE ELSE 0::DOUBLE END + CASE WHEN sh IS NOT NULL THEN 0.2::DOUBLE WHEN sn IS NOT NULL THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN db IS NOT NULL THEN 0.2::DOUBLE WHEN out IS NOT NULL THEN 0.15::DOUBLE WHEN any_db IS NOT NULL OR any_call IS NOT NULL THEN 0.05::DOUBLE ELSE 0::DOUBLE END + CASE WHEN action IS NOT NULL THEN 0.05::DOUBLE ELSE 0::DOUBLE END, 0.95::DOUBLE) AS confidence,
    list_filter(['route ' || method || ' ' || path || ' in ' || file, CASE WHEN ch IS NOT NULL THEN 'controller in same file: ' || ch WHEN cn IS NOT NULL THEN 'controller inferred by module proximity: ' || cn END, CASE WHEN sh IS NOT NULL THEN 'service in same file: ' || sh WHEN sn IS NOT NULL THEN 'service inferred by module proximity: ' || sn END,
      CASE WHEN db IS NOT NULL THEN 'database hint in same module: ' || db WHEN out IS NOT NULL THEN 'external call in same module: ' || out {ELSEWHERE} END, 'route naming suggests ' || action], lambda x: x IS NOT NULL) AS evidence, seq
  FROM (SELECT r.*, ch.v AS ch, cn.v AS cn, sh.v AS sh, sn.v AS sn, d.db, o.out, any_db, any_call, CASE WHEN contains(lower(path), '/admin') THEN 'admin action' WHEN contains(lower(path), '/api') THEN 'api action' WHEN starts_with(lower(path), '/s/') OR contains(lower(path), '/site') THEN 'site action' END AS action
    FROM (SELECT *, {module_key('file')} AS module FROM {RUNTIME} WHERE repo IN (SELECT repo FROM hint WHERE family IN ('framework', 'auth') AND regexp_matches(hint, '^(controller:|service:|omeka_|laminas_)'))) r
    LEFT JOIN ({here('controller:')}) ch ON ch.repo = r.repo AND ch.file = r.file LEFT JOIN ({near('controller:')}) cn ON cn.repo = r.repo AND cn.module = r.module
    LEFT JOIN ({here('service:')}) sh ON sh.repo = r.repo AND sh.file = r.file LEFT JOIN ({near('service:')}) sn ON sn.repo = r.repo AND sn.module = r.module
    LEFT JOIN (SELECT repo, {module_key('file')} AS module, arg_max(kind || ' (' || file || ')', seq) AS db FROM database_hint GROUP BY ALL) d ON d.repo = r.repo AND d.module = r.module
    LEFT JOIN (SELECT repo, {module_key('file')} AS module, arg_max(target || ' (' || file || ')', seq) AS out FROM external_call GROUP BY ALL) o ON o.repo = r.repo AND o.module = r.module LEFT JOIN anywhere a ON a.repo = r.repo)"""
    for k in ("service", "atproto", "framework"):
        out[f"top_{k}"] = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, seq) AS rn FROM {k}_chain) WHERE rn = 1"
    return out


def finding_cte() -> str:
    f = threats.FINDINGS
    run = f"(SELECT * FROM surf WHERE NOT {low('file')})"
    cases = {
        "webhook": (
            "category = 'webhook' AND exposure = 'public' AND method IN ('POST', 'PUT', 'PATCH', 'DELETE', 'ANY') AND (data_store OR outbound)"
            " AND NOT list_has_any(auth_signals, ['jwt', 'oauth', 'authorization', 'service_auth'])"
        ),
        "admin": "category = 'admin'",
        "upload": "category = 'upload'",
        "auth_gap": f"category = 'auth' AND repo NOT IN (SELECT repo FROM {run} WHERE category = 'auth' AND len(auth_signals) > 0)",
        "integration": "exposure = 'public' AND outbound AND repo NOT IN (SELECT repo FROM clean WHERE family = 'auth' AND hint IN ('jwt', 'oauth', 'bearer', 'token'))",
        "public_data": "exposure = 'public' AND data_store AND category <> 'health'",
    }
    parts = [(
        f"SELECT repo, {q(k)} AS rule, {q(f[k][0])} AS title, {q(f[k][1])} AS severity, {q(f[k][2])} AS confidence, evidence"
        f" FROM ({top(f'(SELECT * FROM {run} WHERE {w})', 'repo', 'seq', EVIDENCE, 10)})"
    ) for k, w in cases.items()]
    k = "secret_env"
    parts.append(f"SELECT repo, {q(k)}, {q(f[k][0])}, {q(f[k][1])}, {q(f[k][2])}, evidence FROM ({top('secret_hint', 'repo', 'seq', "name || ' in ' || file", 10)})")
    parts += [(
        f"SELECT repo, {q(k)}, {q(t)}, CASE WHEN {isin('sink', high)} THEN 'high' ELSE 'medium' END, CASE WHEN confidence >= 0.7 THEN 'high' ELSE 'medium' END,"
        f" array_to_string(list_concat(['confidence=' || printf('%.2f', confidence)], list_slice(evidence, 1, 6)), ' | ') FROM ctop_{k}"
    ) for k, (t, high) in threats.CHAIN_FINDINGS.items()]
    return " UNION ALL ".join(parts)


def path_cte() -> str:
    entry = "'Entry: Attacker reaches ' || method || ' ' || path || ' in ' || file"
    proof = "'Evidence: confidence=' || printf('%.2f', confidence) || '; ' || array_to_string(list_slice(evidence, 1, 4), '; ')"
    hop = "CASE WHEN next_service IS NOT NULL THEN 'Propagation: Service trust edge lets the request reach `' || next_service || '`' END"
    env = "CASE WHEN env_risk IS NOT NULL THEN 'Config risk: Behavior depends on env-configured endpoint ' || env_risk END"
    steps = {
        "atproto": (
            f"[{entry}, 'Namespace: Endpoint is exposed in AT Protocol namespace `' || namespace || '`',"
            f" 'Service entry: XRPC request is handled by service `' || entry_service || '`', {hop}, {env},"
            f" 'Sink: Influence reaches ' || sink || ' through protocol-driven service flow', {proof}]"
        ),
        "service": (
            f"[{entry}, 'Service entry: Request is handled by service `' || entry_service || '`', {hop}, {env},"
            f" 'Sink: Influence reaches ' || sink || ' by an unauthorized downstream action', {proof}]"
        ),
        "framework": (
            f"[{entry}, 'Routing: Framework routing maps the request to ' || coalesce(controller, 'framework controller mapping') || ' (' || coalesce(action,"
            f" 'application action') || ')', 'Execution: Controller path likely invokes ' || coalesce(service, 'framework service/factory'),"
            f" 'Sink: Request influence reaches ' || sink || ' and may change state', {proof}]"
        ),
    }
    parts, before = [], []
    for k, s in steps.items():
        gate = " AND ".join(f"repo NOT IN (SELECT repo FROM top_{b})" for b in before) or "true"
        parts.append(f"SELECT repo, 1 AS place, {q(k)} AS kind, {q(threats.PATHS[k])} AS name, list_filter({s}, lambda x: x IS NOT NULL) AS steps FROM top_{k} WHERE {gate}")
        before.append(k)
    conds = {
        "webhook": "category = 'webhook'",
        "admin": "category = 'admin'",
        "auth": "category = 'auth'",
        "upload": "category = 'upload'",
        "public_data": "exposure = 'public' AND data_store AND category <> 'health'",
        "integration": "exposure = 'public' AND outbound",
    }
    firsts = ", ".join(f"arg_min((file, route, method), seq) FILTER (WHERE {w}) AS k_{k}" for k, w in conds.items())
    gate = " AND ".join(f"repo NOT IN (SELECT repo FROM top_{b})" for b in before)
    at = lambda k: f"struct_extract(k_{k}, 3) || ' ' || struct_extract(k_{k}, 2) || ' in ' || struct_extract(k_{k}, 1)"
    live, claims = {"webhook": "w"}, ["CASE WHEN w THEN k_webhook END", "CASE WHEN w THEN k_public_data END", "CASE WHEN w THEN k_integration END"]
    for k in ("admin", "auth", "upload", "public_data", "integration"):
        live[k] = f"(k_{k} IS NOT NULL AND NOT " + " AND NOT ".join(f"coalesce(k_{k} = {c}, false)" for c in claims) + ")"
        claims.append(f"CASE WHEN {live[k]} THEN k_{k} END")
    basic = {
        "webhook": (
            f"['Entry: An attacker reaches ' || {at('webhook')} || ', which takes untrusted events', 'Weak point: The event is trusted before it is verified', CASE"
            f" WHEN k_public_data IS NOT NULL THEN 'Propagation: Attacker input is processed close to a data store' END, CASE"
            f" WHEN k_integration IS NOT NULL THEN 'Propagation: The request can also steer outbound service calls' END,"
            f" 'Impact: Business actions run without a trusted event']"
        ),
        "admin": (
            f"['Entry: An attacker reaches ' || {at('admin')} || ', a privileged route', 'Weak point: Authorization is bypassed or enforced too late',"
            f" 'Propagation: Administrative actions run with attacker influence', 'Impact: Privileged changes follow from one foothold']"
        ),
        "auth": (
            f"['Entry: An attacker targets ' || {at('auth')} || ', which controls login, tokens, or session state',"
            f" 'Weak point: Credentials or tokens are checked weakly', 'Propagation: The weakness becomes an authenticated foothold',"
            f" 'Impact: Protected behavior can be reached']"
        ),
        "upload": (
            f"['Entry: An attacker submits content to ' || {at('upload')}, 'Weak point: Files are accepted or parsed too broadly',"
            f" 'Propagation: Parsers or storage trust the content', 'Impact: Malicious content runs or persists']"
        ),
        "public_data": (
            f"['Entry: An attacker uses ' || {at('public_data')} || ' as a public foothold', 'Weak point: Validation is weaker than the exposure asks',"
            f" 'Propagation: Attacker data reaches code close to the data store', 'Impact: Guarantees about application data weaken']"
        ),
        "integration": (
            f"['Entry: An attacker influences ' || {at('integration')} || ', near an outbound integration', 'Weak point: External answers are trusted too far',"
            f" 'Propagation: Steered third-party calls affect internal logic', 'Impact: Unsafe decisions follow from a weak external boundary']"
        ),
    }
    rows = " UNION ALL ".join((
        f"SELECT repo, {i} AS o, {q(k)} AS kind, {q(threats.PATHS[k])} AS name, list_filter({basic[k]}, lambda x: x IS NOT NULL) AS steps FROM cand"
        f" WHERE {live[k]}"
    ) for i, k in enumerate(conds))
    cand = (
        f"SELECT *, k_webhook IS NOT NULL AND (k_public_data IS NOT NULL OR k_integration IS NOT NULL) AS w FROM (SELECT repo, {firsts} FROM surf_raw"
        f" WHERE NOT {low('file')} AND {gate} GROUP BY repo)"
    )
    parts.append(f"SELECT repo, place::INTEGER, kind, name, steps FROM (WITH cand AS ({cand}) SELECT *, row_number() OVER (PARTITION BY repo ORDER BY o) AS place FROM ({rows})) WHERE place <= 5")
    return " UNION ALL ".join(parts)


def asset_ctes() -> dict[str, str]:
    def matches(source: str, value: str, evidence: str, k: int) -> str:
        return " UNION ALL ".join(f"SELECT repo, {q(r[0])} AS kind, file, {evidence} AS evidence FROM {source} WHERE NOT {low_ext('file')} AND {any_of(value, r[k])}" for r in overlay.ASSETS if r[k])

    files = "(SELECT repo, file FROM route UNION SELECT repo, file FROM secret_hint UNION SELECT repo, file FROM clean WHERE family IN ('framework', 'service', 'auth'))"
    match = " UNION ALL ".join(
        (matches("secret_hint", "lower(name)", f"'secret:' || name || ' (' || {place()} || ')'", 3), matches("route", "lower(path)", f"'route:' || method || ' ' || path || ' (' || {place()} || ')'", 4), matches(files, "lower(file)", "'file:' || file", 5))
    )
    pick = lambda i: "CASE kind " + " ".join(f"WHEN {q(r[0])} THEN {q(r[i])}" for r in overlay.ASSETS) + " END"
    which = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), {q(r[0])}) THEN {i}" for i, r in enumerate(overlay.SECRET_ASSETS)) + " END"
    of = lambda k: "CASE i " + " ".join(f"WHEN {i} THEN {q(r[k])}" for i, r in enumerate(overlay.SECRET_ASSETS)) + " END"
    return {
        "rule_asset": (
            f"SELECT repo, 'asset:' || kind AS id, kind, {pick(1)} AS name, {pick(2)} AS criticality, list_sort(list(DISTINCT file)) AS locations,"
            f" list_slice(list_sort(list(DISTINCT evidence)), 1, 12) AS evidence FROM ({match}) GROUP BY repo, kind"
        ),
        "secret_asset": (
            f"SELECT repo, 'asset:secret:' || lower(name) AS id, {of(1)} AS kind, {of(2)} || ': ' || name AS name, {of(3)} AS criticality, [file] AS locations,"
            f" ['secret:' || name || ' (' || {place()} || ')'] AS evidence FROM (SELECT *, {which} AS i, row_number() OVER (PARTITION BY repo, lower(name)"
            f" ORDER BY seq) AS rn FROM secret_hint WHERE NOT {low_ext('file')} AND {which} IS NOT NULL) WHERE rn = 1"
        ),
        "asset": (
            f"SELECT * FROM rule_asset UNION ALL SELECT * FROM secret_asset UNION ALL SELECT repo, 'asset:business_data', 'business_data',"
            f" 'Business / operational data store', 'medium', list_slice(list_sort(list(DISTINCT file)), 1, 8), list_transform(list_sort(list(DISTINCT kind)),"
            f" lambda k: 'datastore:' || k) FROM database_hint WHERE NOT {low_ext('file')} AND repo NOT IN (SELECT repo FROM rule_asset"
            f" WHERE {isin('kind', overlay.SENSITIVE)} UNION SELECT repo FROM secret_asset WHERE {isin('kind', overlay.SENSITIVE)}) GROUP BY repo"
        ),
    }


def control_ctes() -> dict[str, str]:
    blob = "(SELECT repo, hint AS label, file, line FROM clean UNION ALL SELECT repo, path, file, line FROM route)"
    hits = " UNION ALL ".join(f"SELECT repo, {i} AS i, file, label || ' (' || {place()} || ')' AS e FROM {blob} WHERE regexp_matches(label, {q('(?i)' + r[3])})" for i, r in enumerate(overlay.CONTROLS))
    of = lambda k: "CASE i " + " ".join(f"WHEN {i} THEN {q(r[k])}" for i, r in enumerate(overlay.CONTROLS)) + " END"
    need = (
        ("rate_limiting", "exposure = 'public'", 0),
        ("authentication", "category IN ('admin', 'auth')", 0),
        ("csrf_protection", "exposure = 'public' AND upper(method) IN ('POST', 'PUT', 'PATCH', 'DELETE')", 0),
        ("audit_logging", SENSITIVE, 1),
        ("encryption_at_rest", SENSITIVE, 1),
        ("mfa", "category IN ('admin', 'auth')", 0),
    )
    names = dict(overlay.ABSENT)
    missing = " UNION ALL ".join((
        f"SELECT DISTINCT repo, 'control:absent:{k}' AS id, '{k}' AS kind, {q(names[k])} AS name FROM {('surf', 'asset')[t]} WHERE {w}"
        f" AND repo NOT IN (SELECT repo FROM present WHERE kind = '{k}')"
    ) for k, w, t in need)
    return {
        "present": (
            f"SELECT repo, 'control:' || {of(0)} || ':' || replace(replace(lower({of(1)}), ' ', '_'), '/', '_') AS id, {of(0)} AS kind, {of(1)} AS name, {of(2)}"
            f" AS strength, CASE WHEN len(p) >= 3 THEN 'global' WHEN len(p) > 1 THEN 'module' ELSE 'route' END AS scope, list_slice(p, 1, 12) AS placements,"
            f" list_slice(e, 1, 8) AS evidence FROM (SELECT repo, i, list_sort(list(DISTINCT file)) AS p, list_sort(list(DISTINCT e)) AS e FROM ({hits})"
            f" GROUP BY repo, i)"
        ),
        "absent": missing,
        "control": "SELECT * FROM present UNION ALL SELECT repo, id, kind, name, 'absent', 'global', [], [] FROM absent",
    }


def said(template: str, values: dict[str, str]) -> str:
    """A template with its names in braces replaced by SQL expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(f"({values[x]})::VARCHAR" if i % 2 else q(x) for i, x in enumerate(parts)) + ")"


def insight(kind: str, id_: str, severity: str, evidence: str, source: str, values: dict[str, str], confidence: str = "'medium'", assets: str = "[]", controls: str = "[]", routes: str = "[]") -> str:
    title, narrative, action = (said(t, values) for t in overlay.TEXTS[kind])
    joined = ", ".join(f"array_to_string({x}::VARCHAR[], ', ') AS {k}" for k, x in (("assets", assets), ("controls", controls), ("routes", routes)))
    return (
        f"SELECT repo, {id_} AS id, {q(kind)} AS kind, {title} AS title, {narrative} AS narrative, {severity} AS severity, {confidence} AS confidence, "
        f"{evidence} AS evidence, {joined}, {action} AS action FROM {source}"
    )


def lines(source: str, keys: str, note: str, n: int) -> str:
    """keys, n, evidence, routes: a count of source's rows by keys, and its first lines in the order of seq."""
    line = f"method || ' ' || route || ' (' || {place()} || ')' || {q(note)}"
    return (
        f"SELECT {keys}, max(n) AS n, string_agg(v, ' | ' ORDER BY rn) AS evidence, list(route ORDER BY rn) AS routes FROM (SELECT {keys}, route, {line} AS v, "
        f"row_number() OVER (PARTITION BY {keys} ORDER BY seq) AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM ({source})) WHERE rn <= {n} GROUP BY {keys}"
    )


def insight_ctes() -> dict[str, str]:
    there = lambda kind: f"repo IN (SELECT repo FROM control WHERE kind = {q(kind)} AND strength <> 'absent')"
    public = "exposure = 'public'"
    of = lambda *names: {k: k for k in names}
    near = (
        f"SELECT s.repo, s.name, list(DISTINCT a.id) AS ids FROM secret_hint s JOIN (SELECT repo, id, unnest(locations) AS file FROM asset) a ON a.repo = s.repo"
        f" AND a.file = s.file WHERE NOT {low_ext('s.file')} GROUP BY ALL"
    )
    secret = f"""(SELECT f.*, x.ids FROM (SELECT *, row_number() OVER (PARTITION BY repo, lower(name) ORDER BY first) AS rn FROM (
      SELECT repo, name, count(DISTINCT {module("file")}) AS modules, count(DISTINCT file) AS files, min(seq) AS first, list_slice(list_sort(list(DISTINCT {place()})), 1, 8) AS e
      FROM secret_hint WHERE NOT {low_ext("file")} GROUP BY repo, name) WHERE modules >= 3) f LEFT JOIN ({near}) x USING (repo, name) WHERE rn = 1)"""
    open_ = f"""SELECT s.*, m.asset, m.asset_name, m.criticality FROM surf s JOIN (SELECT DISTINCT repo, id AS asset, name AS asset_name, criticality, {module("l")} AS module
      FROM (SELECT *, unnest(locations) AS l FROM asset WHERE {SENSITIVE})) m ON m.repo = s.repo AND m.module = {module("s.file")} WHERE {public} AND len(auth_signals) = 0"""
    missing = " || ".join(f"CASE WHEN {there(k)} THEN '' ELSE ', {k}' END" for k in insights.ON_THE_WAY)
    gap = (
        f"(SELECT *, name AS path, substr(m, 3) AS missing FROM (SELECT *, {missing} AS m FROM path WHERE place <= 8"
        f" AND {any_of("lower(array_to_string(steps, ' '))", insights.DATA_WORDS)}) WHERE m <> '')"
    )
    expected = " UNION ALL ".join(f"SELECT {q(a)} AS akind, {i} AS o, {q(k)} AS ckind" for a, ks in overlay.EXPECTED.items() for i, k in enumerate(ks))
    mismatch = f"""(SELECT a.repo, a.id AS asset_id, a.name AS asset, a.criticality, string_agg(x.ckind, ', ' ORDER BY x.o) AS expected, string_agg('asset:' || a.id || ' expects ' || x.ckind, ' | ' ORDER BY x.o) AS e,
      string_agg(CASE WHEN c.weak IS NULL THEN x.ckind || ' (absent)' WHEN c.weak THEN x.ckind || ' (weak only)' END, ', ' ORDER BY x.o) AS gaps FROM asset a JOIN ({expected}) x ON x.akind = a.kind
      LEFT JOIN (SELECT repo, kind, bool_and(strength = 'weak') AS weak FROM control WHERE strength <> 'absent' GROUP BY ALL) c ON c.repo = a.repo AND c.kind = x.ckind
      WHERE a.criticality IN ('critical', 'high') GROUP BY a.repo, a.id, a.name, a.criticality HAVING gaps IS NOT NULL)"""
    methods = lambda w: f"array_to_string(list_sort(list(DISTINCT method) FILTER (WHERE {w})), ', ')"
    safe, bare = "len(auth_signals) > 0", "len(auth_signals) = 0"
    split = (
        f'(SELECT repo, route, count(*) FILTER (WHERE {safe}) AS guarded, count(*) FILTER (WHERE {bare}) AS open, {methods(safe)} AS w, {methods(bare)} AS o'
        f' FROM surf GROUP BY ALL HAVING count(*) FILTER (WHERE {safe}) > 0 AND count(*) FILTER (WHERE {bare}) > 0)'
    )
    order = rank("criticality", overlay.CRITICALITY)
    unlogged = f"""(SELECT repo, count(*) AS n, left(array_to_string(list_sort(list(DISTINCT name)), ', '), 160) AS names, list(id ORDER BY {order}, kind, id) AS ids,
      list('asset:' || id || ' (' || criticality || ')' ORDER BY {order}, kind, id) AS e FROM asset WHERE (criticality IN ('critical', 'high') OR {isin("kind", insights.PROTECTED_KINDS)}) AND NOT {there("audit_logging")} GROUP BY repo)"""
    alone = f"(SELECT repo, min(name) AS name FROM secret_hint WHERE NOT {low_ext('file')} AND {any_of('lower(name)', overlay.AUTH_SECRET_WORDS)} GROUP BY repo HAVING count(DISTINCT name) = 1)"
    admin = (
        f"SELECT * FROM surf WHERE {public} AND (upper(method) IN ('POST', 'PUT', 'PATCH', 'DELETE') OR category = 'admin') AND {bare} AND (category = 'admin'"
        f" OR {any_of('lower(route)', overlay.ADMIN_PARTS)})"
    )
    inside = f"SELECT * FROM surf WHERE {public} AND {any_of(wrap('file'), overlay.INTERNAL_PARTS)}"
    stale = f"SELECT * FROM surf WHERE {safe} AND {any_of('lower(route)', overlay.BENIGN_PARTS)}"
    there_placed = f"SELECT DISTINCT repo, kind AS control, unnest(placements) AS file FROM control WHERE {isin('kind', insights.BYPASSED)} AND strength <> 'absent'"
    prone = f"""SELECT s.*, b.control, b.files FROM surf s JOIN (SELECT repo, control, count(*) AS files FROM ({there_placed}) GROUP BY ALL HAVING count(*) >= 2) b ON b.repo = s.repo
      WHERE {public} AND {any_of("lower(route)", overlay.BYPASS_PARTS)} AND NOT EXISTS (SELECT 1 FROM ({there_placed}) p WHERE p.repo = s.repo AND p.control = b.control AND p.file = s.file)"""
    bypass = (
        f"(SELECT * FROM ({lines(prone, 'repo, control, files', ' - not in this file', 5)}) JOIN (SELECT repo, kind AS control, list_sort(list(DISTINCT id))"
        f" AS ids FROM control WHERE strength <> 'absent' GROUP BY ALL) USING (repo, control))"
    )
    return {
        "ins_shared_secret": insight(
            "shared_secret_blast_radius",
            "'insight:shared-secret:' || lower(name)",
            f"CASE WHEN {any_of('lower(name)', overlay.SECRET_WORDS)} THEN 'high' ELSE 'medium' END",
            "array_to_string(list_transform(e, lambda x: name || ' (' || x || ')'), ' | ')",
            secret,
            of("name", "modules", "files"),
            "CASE WHEN modules >= 4 THEN 'high' ELSE 'medium' END",
            "list_sort(coalesce(ids, []))",
        ),
        "ins_asset_reachability": insight(
            "sensitive_asset_reachability",
            "'insight:asset-reachable:' || asset",
            "CASE WHEN criticality = 'critical' THEN 'critical' ELSE 'high' END",
            "evidence",
            f"({lines(open_, 'repo, asset, asset_name, criticality', ' - public, no auth', 5)})",
            {"asset": "asset_name", "criticality": "criticality", "n": "n"},
            assets="[asset]",
            routes="routes",
        ),
        "ins_defense_gap": insight(
            "defense_gap_in_chain",
            "'insight:defense-gap:' || place",
            "CASE WHEN contains(missing, 'authentication') THEN 'high' ELSE 'medium' END",
            "array_to_string(list_slice(steps, 1, 6), ' | ')",
            gap,
            of("path", "missing"),
        ),
        "ins_strength_mismatch": insight(
            "control_strength_mismatch",
            "'insight:strength-mismatch:' || asset_id",
            "CASE WHEN criticality = 'critical' THEN 'high' ELSE 'medium' END",
            "e",
            mismatch,
            of("asset", "criticality", "gaps", "expected"),
            assets="[asset_id]",
        ),
        "ins_asymmetric": insight(
            "asymmetric_protection",
            "'insight:asymmetric:' || route",
            "'medium'",
            "'guarded: ' || w || ' | open: ' || o",
            split,
            {"route": "route", "guarded": "guarded", "with": "w", "open": "open", "without": "o"},
            routes="[route]",
        ),
        "ins_audit_gap": insight("audit_gap", "'insight:audit-gap:global'", "'medium'", "array_to_string(list_slice(e, 1, 6), ' | ')", unlogged, of("n", "names"), assets="ids"),
        "ins_spof": insight("single_point_of_failure", "'insight:spof:' || lower(name)", "'high'", "'secret:' || name", f"(SELECT * FROM {alone} WHERE {there('authentication')})", of("name")),
        "ins_admin_no_auth": insight(
            "admin_action_without_auth",
            "'insight:admin-without-auth'",
            "'critical'",
            "evidence",
            f"({lines(admin, 'repo', ' - public, no auth', 6)})",
            of("n"),
            routes="routes",
        ),
        "ins_control_bypass": insight("control_bypass", "'insight:control-bypass:' || control", "'medium'", "evidence", bypass, of("n", "control", "files"), controls="ids", routes="routes"),
        "ins_trust_boundary": insight(
            "trust_boundary_violation",
            "'insight:trust-boundary-violation'",
            "'high'",
            "evidence",
            f"({lines(inside, 'repo', ' - internal by path, public', 5)})",
            of("n"),
            routes="routes",
        ),
        "ins_stale_signal": insight(
            "stale_or_contradictory_signal",
            "'insight:stale-signal'",
            "'informational'",
            "evidence",
            f"({lines(stale, 'repo', ' - auth on a benign route', 5)})",
            of("n"),
            routes="routes",
        ),
    }


def technique_ctes() -> dict[str, str]:
    of_kind = "CASE kind " + " ".join(f"WHEN {q(k)} THEN [{', '.join(map(q, v))}]" for k, v in overlay.INSIGHT_TECHNIQUES.items()) + " ELSE [] END"
    words = "lower(title || ' ' || replace(evidence, ' | ', ' '))"
    groups = [f"CASE WHEN {any_of(words, parts)} THEN [{', '.join(map(q, ids))}] ELSE [] END" for parts, ids in overlay.FINDING_TECHNIQUES]
    all_ids = f"flatten([{', '.join(groups)}])"
    # distinct in the order of first appearance
    distinct = "list_transform(list_filter(list_zip(g, range(1, len(g) + 1)), lambda z: list_position(g, z[1]) = z[2]), lambda z: z[1])"
    return {
        "ins_tech": f"SELECT *, {of_kind} AS techniques FROM insight",
        "fnd_tech": f"SELECT * EXCLUDE (g), {distinct} AS techniques FROM (SELECT *, {all_ids} AS g FROM finding)",
    }


def library() -> dict[str, str]:
    """All named relations, each after those it reads."""
    out = dict(oracle_ctes())
    out["clean"] = (
        f"SELECT repo, family, hint, file, CASE WHEN family = 'auth' THEN NULL ELSE line END AS line, CASE WHEN family = 'auth' THEN 0.7::DOUBLE"
        f" ELSE confidence END AS confidence, seq FROM hint h WHERE family <> 'auth' OR (({AUTH_LIKE}) AND NOT EXISTS (SELECT 1 FROM hint o"
        f" WHERE o.family <> 'auth' AND o.repo = h.repo AND o.hint = h.hint AND o.file = h.file))"
    )
    out["surf"], out["surf_raw"] = surface("clean"), surface("hint")
    raw = chain_ctes()
    out |= raw
    # The same chains over filtered hints feed the findings: every chain relation once more, under the prefix c.
    for name, sql in raw.items():
        out[f"c{name}"] = own(sql, raw)
    out["found"] = finding_cte()
    title, severity, confidence = threats.FINDINGS["fallback"]
    out["finding"] = (
        f"SELECT * FROM found UNION ALL SELECT repo, 'fallback', {q(title)}, {q(severity)}, {q(confidence)}, 'No strong pattern was found.' FROM repo"
        f" WHERE repo NOT IN (SELECT repo FROM found)"
    )
    out["path"] = path_cte()
    out |= asset_ctes() | control_ctes() | insight_ctes()
    out["insight"] = " UNION ALL ".join(f"SELECT * FROM {n}" for n in insight_ctes())
    out |= technique_ctes()
    return out


def own(sql: str, names: dict[str, str]) -> str:
    """A chain relation over filtered hints: the relations after FROM and JOIN get the prefix c, and hint is clean."""
    read = {n: f"c{n}" for n in names} | {"hint": "clean"}
    return re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {read.get(m[2], m[2])}", sql)


LIBRARY = library()


def row_text(df: DataFrame, relation: str, columns: tuple[str, ...]) -> DataFrame:
    """repo, relation, content: the rows of a relation as one text each; lists are joined by commas, nulls are dashes."""
    lists = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    value = lambda k: F.array_join(k, ", ") if k in lists else F.col(k).cast("string")
    return df.select("repo", F.lit(relation).alias("relation"), F.concat_ws(" | ", *(F.coalesce(value(k), F.lit("-")) for k in columns)).alias("content"))


def row_sql(table: str, relation: str, columns: tuple[str, ...], lists: tuple[str, ...] = ()) -> str:
    """The same in SQL; lists names the columns that hold lists there."""
    value = lambda k: f"array_to_string({k}, ', ')" if k in lists else f"{k}::VARCHAR"
    return f"SELECT repo, {q(relation)} AS relation, concat_ws(' | ', {', '.join(f'coalesce({value(k)}, {q("-")})' for k in columns)}) AS content FROM {table}"


def oracle(select: str) -> str:
    """A statement over the library; only what it needs is named."""
    needed: set[str] = set()

    def need(sql: str) -> None:
        for n in set(re.findall(r"\b(?:FROM|JOIN) (\w+)\b", sql)) & LIBRARY.keys() - needed:
            needed.add(n)
            need(LIBRARY[n])

    need(select)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({LIBRARY[n]})" for n in LIBRARY if n in needed) + " " + select if needed else select
