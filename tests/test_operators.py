"""Operators of the security-fact engine on small relations of our own, and invariants over the made ones."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import expressions as E
from factloom.operators import extract, overlay, signals, surfaces, threats
from factloom.plans import queries as plans
from factloom.sources.adapters import Scan

SMALL = "/root/testdata/sf0.001"
SCHEMAS = {
    "repo": "repo string",
    "route": "repo string, path string, method string, file string, line int, seq long",
    "external_call": "repo string, target string, file string, line int, seq long",
    "database_hint": "repo string, kind string, file string, line int, seq long",
    "hint": "repo string, family string, hint string, file string, line int, confidence double, seq long",
    "secret_hint": "repo string, name string, file string, line int, confidence double, seq long",
}


def scan(spark, **rows):
    rows.setdefault("repo", [("r",)])
    return Scan(*(spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()))


def test_first_seen_counts(spark):
    s = scan(spark, secret_hint=[("r", "A_KEY", "f", 9, 0.8, 2), ("r", "A_KEY", "f", 3, 0.8, 1), ("q", "A_KEY", "f", 1, 0.8, 5)])
    got = signals.merged(s).secret_hint.repartition(3).select("repo", "line").collect()
    assert sorted(map(tuple, got)) == [("q", 1), ("r", 3)]


def test_auth_filter_drops_other_families(spark):
    s = scan(spark, hint=[("r", "auth", "jwt", "f", 1, 0.9, 1), ("r", "auth", "service_name:token", "f", 1, 0.9, 2), ("r", "auth", "oauth", "g", 1, 0.9, 3), ("r", "protocol", "oauth", "g", 1, 0.9, 4)])
    assert [r.hint for r in signals.auth_filtered(s).hint.where("family = 'auth'").collect()] == ["jwt"]


def test_surface_classes(spark):
    paths = ["/webhook/x", "/Admin/x", "/login", "/upload", "/debug", "/health", "/x"]
    s = scan(spark, route=[("r", p, "POST", f"f{i}", i, i) for i, p in enumerate(paths)], database_hint=[("r", "redis", "d", 1, 1)])
    got = [tuple(r) for r in surfaces.identify_attack_surfaces(s).orderBy("seq").select("category", "exposure", "risk").collect()]
    assert got == [("webhook", "public", "high"), ("admin", "public", "high"), ("auth", "public", "high"), ("upload", "public", "high"), ("internal", "internal", "medium"), ("health", "public", "low"), ("public_api", "public", "medium")]


def test_auth_signals_fall_back_to_the_repository(spark):
    s = scan(spark, route=[("r", "/a", "GET", "f", 1, 1), ("r", "/b", "GET", "g", 1, 2)], hint=[("r", "auth", "jwt", "f", 1, 0.9, 1), ("r", "auth", "oauth", "h", 1, 0.9, 2)])
    got = {r.route: r.auth_signals for r in surfaces.identify_attack_surfaces(s).collect()}
    assert got == {"/a": ["jwt"], "/b": ["jwt", "oauth"]}


def test_classified_rows_hold_flags_of_the_set_not_the_set(spark):
    hints = [("r", "auth", h, f, 1, 0.9, i) for i, (h, f) in enumerate((("bearer", "f"), ("oauth", "h"), ("ATPROTO_x", "h"), (None, "n")))]
    s = scan(spark, route=[("r", f"/{f}", "GET", f, 1, i) for i, f in enumerate("fgn")], hint=[*hints, ("r", "service", "jwt", "g", 1, 0.9, 9)])
    rows = surfaces.classified(s)
    assert not [f.name for f in rows.schema if f.dataType.typeName() == "array"] and "rationale" not in rows.columns
    got = {r.route: (r.own_auth, r.guarded, r.trusted, r.protocol_auth) for r in rows.collect()}
    # A file's own set counts alone; a hint of another family, as in g, is no auth set; a set of nulls, as in n, is empty.
    assert got == {"/f": (True, True, False, False), "/g": (False, True, True, True), "/n": (True, False, False, False)}
    full = {r.route: (r.auth_signals, "No auth" in r.rationale) for r in surfaces.expanded(rows, s).collect()}
    assert full == {"/f": (["bearer"], False), "/g": (["ATPROTO_x", "bearer", "oauth"], False), "/n": ([], True)}


def test_classified_rows_do_not_grow_with_hints(spark, tmp_path):
    def size(n):
        s = scan(spark, route=[("r", f"/p{i}", "GET", "f", 1, i) for i in range(300)], hint=[("r", "auth", f"signal_{i}", "g", 1, 0.9, i) for i in range(n)])
        surfaces.classified(s).coalesce(1).write.parquet(str(tmp_path / str(n)))
        return sum(f.stat().st_size for f in (tmp_path / str(n)).glob("*.parquet"))

    assert size(2000) == size(1)


def test_empty_scan_gives_the_fallback_finding(spark):
    s = scan(spark)
    found = surfaces.identify_attack_surfaces(s)
    assert [r.rule for r in threats.generate_findings(s, found).collect()] == ["fallback"]
    assert threats.generate_attack_paths(s, found).count() == 0


def test_paths_claim_a_surface_once(spark):
    s = scan(spark, route=[("r", "/webhook/a", "POST", "f", 1, 1), ("r", "/admin", "GET", "f", 2, 2)], database_hint=[("r", "redis", "d", 1, 1)])
    got = threats.generate_attack_paths(s, surfaces.identify_attack_surfaces(s)).orderBy("place").collect()
    assert [r.kind for r in got] == ["webhook", "admin"] and [r.place for r in got] == [1, 2]


def test_assets_and_missing_controls(spark):
    s = scan(spark, route=[("r", "/login", "POST", "f", 1, 1)], secret_hint=[("r", "JWT_SECRET", "a", 1, 0.8, 1), ("r", "JWT_SECRET", "tests/a", 1, 0.8, 2)])
    assets = overlay.detect_assets(s)
    assert sorted(r.id for r in assets.collect()) == ["asset:secret:jwt_secret", "asset:session"]
    missing = overlay.detect_controls(s, surfaces.identify_attack_surfaces(s), assets).where("strength = 'absent'")
    assert sorted(r.kind for r in missing.collect()) == ["audit_logging", "authentication", "csrf_protection", "encryption_at_rest", "mfa", "rate_limiting"]


FOUND = "repo string, rule string, title string, severity string, confidence string, evidence string"
INSIGHT = "repo string, id string, kind string, title string, severity string, confidence string, evidence string"


def test_findings_without_insights_give_the_residual_detection(spark):
    titles = [("high", "b webhook"), ("high", "a admin secret"), ("low", "z command"), ("medium", "c plain"), ("medium", "d upload"), ("medium", "e login")]
    found = [("r", f"x{i}", t, s, "high", "") for i, (s, t) in enumerate(titles)] + [("q", "x", "admin", "high", "high", ""), ("p", "x", "nothing", "high", "high", "")]
    findings = spark.createDataFrame(found, FOUND)
    insights = spark.createDataFrame([("q", "insight:a", "audit_gap", "no admin logging", "high", "high", "")], INSIGHT)
    got = {(r.repo, r.id): r for r in overlay.detection_opportunities(insights, findings).collect()}
    assert set(got) == {("r", "detect:findings:residual"), ("q", "detect:insight:a")}
    row = got["r", "detect:findings:residual"]
    assert row.signal == "log" and row.insight is None and row.findings == "a admin secret | b webhook | c plain | d upload | e login"
    assert row.techniques == "T1078,T1068,T1098,T1552,T1528,T1190"
    con = duckdb.connect()
    con.execute("create table fnd_tech(repo text, rule text, title text, severity text, techniques text[]); create table ins_tech(repo text)")
    for r in overlay.finding_techniques(findings).collect():
        con.execute("insert into fnd_tech values (?, ?, ?, ?, ?)", [r.repo, r.rule, r.title, r.severity, r.techniques])
    con.execute("insert into ins_tech values ('q')")
    sql = plans.oracle_sql()["det_residual"]
    want = con.sql(f"select repo, id, signal, techniques, findings {sql[sql.rindex('SELECT * FROM (SELECT repo,') + 8 :]}").fetchall()
    assert want == [("r", row.id, row.signal, row.techniques, row.findings)]


def test_mounted_routes(spark):
    text = "api = APIRouter(prefix='/api')\nv1 = APIRouter(prefix='v1/')\nusers = APIRouter()\napi.include_router(v1)\nv1.include_router(users, prefix='/users')\n@users.get('list')\n@api.api_route('/x', methods=['POST', 'ALL'])\n@lone.post('/y')\n"
    files = spark.createDataFrame([("r", "a.py", ".py", text)], "repo string, file string, suffix string, content string")
    got = sorted((r.path, r.method, r.line) for r in extract.extract_routes(files).collect())
    assert got == [("/api/v1/users/list", "GET", 6), ("/api/x", "ANY", 7), ("/api/x", "POST", 7), ("/y", "POST", 8)]


def test_mount_cycles_end(spark):
    text = "a.use('/a', b);\nb.use('/b', a);\nb.get('/x', f)\n"
    files = spark.createDataFrame([("r", "a.js", ".js", text)], "repo string, file string, suffix string, content string")
    assert extract.extract_routes(files).count() == 1


@pytest.mark.parametrize("depth", [1, 2, 17, 40])
def test_mounts_of_any_depth(spark, depth):
    text = "".join(f"r{i}.use('/p{i}', r{i + 1});\n" for i in range(depth)) + f"r{depth}.get('/x', f)\na.use('/a', b);\nb.use('/b', a);\nb.use('/c', d);\nd.get('/y', f)\n"
    files = spark.createDataFrame([("r", "a.js", ".js", text), ("r", "b.js", ".js", "r0.use('/q', r1);\nr1.get('/z', f)\n")], "repo string, file string, suffix string, content string")
    got = sorted(r.path for r in extract.extract_routes(files).collect())
    assert got == sorted(["".join(f"/p{i}" for i in range(depth)) + "/x", "/y", "/q/z"])


def test_all_assets_are_numbered(spark):
    rows = spark.range(1005).selectExpr("'r' AS repo", "lpad(id, 5, '0') AS id", "'internal_secret' AS kind", "'high' AS criticality")
    assert [(r.place, r.id) for r in overlay.ordered_assets(rows).orderBy("place").collect()] == [(i + 1, f"{i:05}") for i in range(1005)]


def test_snippets_and_lines(spark):
    text = "\n\n   os.getenv('API_KEY')" + "x" * 300 + "\nos.getenv('B_TOKEN')"
    files = spark.createDataFrame([("r", "a.py", ".py", text)], "repo string, file string, suffix string, content string")
    got = sorted((r.name, r.line, len(r.evidence)) for r in extract.extract_secrets(files).collect())
    assert got == [("API_KEY", 3, 160), ("B_TOKEN", 4, 20)]


def test_paths_are_normal(spark):
    rows = spark.createDataFrame([("", "x"), ("/a/", "//b"), (None, ""), ("a", "/")], "p string, x string")
    got = [r[0] for r in rows.select(E.join_route_parts(rows.p, rows.x)).collect()]
    assert got == ["/x", "/a/b", "/", "/a"]


@pytest.mark.parametrize("name", ["identify_attack_surfaces", "mrg_routes", "xlt_to_findings", "xlt_to_paths", "ast_detect", "ctl_detect", "chn_service", "ext_routes", "evl_score"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.partition('.')[0]} as select * from '{SMALL}/{f}'")
    df = plans.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({plans.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_partitioning_does_not_matter(spark):
    a = plans.analysis(spark, SMALL).scan
    b = Scan(a.repo, a.route.repartition(7), a.external_call.repartition(5), a.database_hint.repartition(3), a.hint.repartition(1), a.secret_hint.repartition(4))
    assert sorted(map(str, signals.merged(a).hint.collect())) == sorted(map(str, signals.merged(b).hint.collect()))
    assert sorted(map(str, surfaces.identify_attack_surfaces(a).collect())) == sorted(map(str, surfaces.identify_attack_surfaces(b).collect()))


def test_evidence_goes_with_the_first_row_of_a_key(spark):
    plain = scan(spark, secret_hint=[("r", "A_KEY", "f", 3, 0.8, 1)])
    told = scan(spark, secret_hint=[("r", "A_KEY", "f", 9, 0.8, 1), ("r", "B_KEY", "f", 4, 0.8, 2)])
    told = told.__class__(**vars(told) | {"secret_hint": told.secret_hint.selectExpr("*", "concat('line ', line) AS evidence")})
    meta = spark.createDataFrame([("r", ["python"], 1)], "repo string, languages array<string>, files_scanned long")
    for turns, want in (([plain, told], {"A_KEY": None, "B_KEY": "line 4"}), ([told, plain], {"A_KEY": "line 9", "B_KEY": "line 4"})):
        found = signals.merge_results([signals.Result(s, meta) for s in turns], plain.repo)
        assert {r.label: r.evidence for r in signals.all_signals(found.scan).collect()} == want


def test_rows_come_with_the_size_of_their_group(spark):
    rows = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", None), ("q", "a")], "repo string, k string").repartition(3)
    assert sorted(E.with_count(rows, ["repo", "k"]).collect(), key=str) == sorted([("r", "a", 2), ("r", "a", 2), ("r", None, 1), ("q", "a", 1)], key=str)
    got = plans.queries()["sur_internal_override"](spark, SMALL).collect()
    sizes = {}
    for r in got:
        key = r.repo, r.category, r.exposure, r.risk
        sizes[key] = sizes.get(key, 0) + 1
    assert got and all(r.n == sizes[r.repo, r.category, r.exposure, r.risk] for r in got)


def test_the_overlay_is_whole(spark):
    a = plans.analysis(spark, SMALL)
    got = {}
    for r in plans.queries()["overlay_build"](spark, SMALL).collect():
        got.setdefault(r.relation, []).append(r)
    for name in ("assets", "controls", "insights", "findings", "opportunities"):
        relation = getattr(a.overlay, name)
        assert len(got.get(name, ())) == relation.count() and all(r.content.count(" | ") >= len(relation.columns) - 2 for r in got[name]), name
        assert {r.repo: r.n for r in got[name]} == {r.repo: r["count"] for r in relation.groupBy("repo").count().collect()}, name


def overlay_sql(con, spark, insights, findings):
    """The rows of opportunities that overlay_build's own SQL makes of these insights and findings, without the relations before them."""
    insights = overlay.insight_techniques(insights).withColumn("routes", F.array_join("routes", ", "))
    for name, df in (("ins_tech", insights), ("fnd_tech", overlay.finding_techniques(findings)), ("finding", findings)):
        types = ["text[]" if t.startswith("array") else "text" for _, t in df.dtypes]
        con.execute(f"create table {name}({', '.join(f'{c} {t}' for c, t in zip(df.columns, types))})")
        for r in df.collect():
            con.execute(f"insert into {name} values ({', '.join('?' * len(r))})", list(r))
    sql = plans.oracle_sql()["overlay_build"]
    return con.sql(sql[sql.rindex("SELECT repo, 'opportunities' AS relation") : -1]).fetchall()


def test_opportunities_of_the_whole_overlay_name_all_they_relate_to(spark):
    levels, routes = ("high", "low", "medium"), [f"/r{i}" for i in range(5)]
    words = ("webhook", "admin secret", "command", "plain", "upload", "login", "exfil")
    found = [(repo, f"x{i}", f"{w} routes", levels[i % 3], "high", "") for repo in "rq" for i, w in enumerate(words)]
    findings = spark.createDataFrame(found, FOUND)
    insights = spark.createDataFrame([("r", "insight:a", "sensitive_asset_reachability", "a", "high", "high", "", routes)], INSIGHT + ", routes array<string>")
    order = [t for _, t in sorted((("high", "medium", "low").index(r[3]), r[2]) for r in found[:7])]
    ids = ["T1078", "T1068", "T1098", "T1552", "T1528", "T1190", "T1199", "T1059", "T1110", "T1556", "T1041"]
    few = {r.repo: r for r in overlay.detection_opportunities(insights, findings).collect()}
    assert few["r"].findings == " | ".join(order[:3]) and "`/r2`)" in few["r"].rule and few["q"].findings == " | ".join(order[:5]) and few["q"].techniques.count(",") == 5
    got = {r.repo: r for r in overlay.detection_opportunities(insights, findings, whole=True).collect()}
    assert got["r"].findings == got["q"].findings == " | ".join(order) and "(`/r0`, `/r1`, `/r2`, `/r3`, `/r4`)" in got["r"].rule
    assert sorted(got["q"].techniques.split(",")) == sorted(ids)
    shown = {(r.repo, "opportunities", " | ".join("-" if v is None else v for v in r[1:])) for r in got.values()}
    assert shown == set(overlay_sql(duckdb.connect(), spark, insights, findings))


def test_the_overlay_cuts_no_opportunity(spark):
    a = plans.analysis(spark, SMALL)
    whole = {(r.repo, r.id): " | ".join("-" if v is None else v for v in r[1:]) for r in overlay.detection_opportunities(a.insights, a.findings, whole=True).collect()}
    rows = [r for r in plans.queries()["overlay_build"](spark, SMALL).collect() if r.relation == "opportunities"]
    assert whole and {(r.repo, r.content.split(" | ")[0]): r.content for r in rows} == whole
    sql = plans.oracle_sql()["overlay_build"]
    own = sql[sql.rindex("SELECT repo, 'opportunities' AS relation") :]
    assert "LIMIT" not in own and "list_slice" not in own and "<=" not in own


@pytest.mark.parametrize("name", ["sur_internal_override", "overlay_build"])
def test_oracle_of_whole_relations(spark, name):
    test_oracle(spark, name)
