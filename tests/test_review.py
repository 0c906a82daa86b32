"""Review views and sinks on small relations."""

import json

from pyspark.sql import functions as F

from factloom.operators import protection, review
from factloom.operators.surfaces import flagged
from factloom.plans import queries as plans
from factloom.sources import reports

SURFACE = "repo string, route string, method string, file string, line int, category string, exposure string, risk string, auth_signals array<string>, data_store boolean, outbound boolean, rationale string, seq long"
FINDING = "repo string, rule string, title string, severity string, confidence string, evidence string"
PATH = "repo string, place int, kind string, name string, steps array<string>"


def surface(route, file="a.py", exposure="public", category="public_api", risk="low", seq=1, auth=(), repo="r"):
    return (repo, route, "GET", file, 1, category, exposure, risk, list(auth), True, False, "", seq)


def test_hotspots_take_tests_only_without_others(spark):
    rows = [surface("/a", "tests/a.py", risk="high"), surface("/b", seq=2), surface("/t", "tests/a.py", repo="q")]
    got = review.hotspots(flagged(spark.createDataFrame(rows, SURFACE))).select("repo", "route").collect()
    assert sorted(map(tuple, got)) == [("q", "/t"), ("r", "/b")]


def test_classes_and_basis(spark):
    rows = [surface("/xrpc/x"), surface("/i", exposure="internal", seq=2), surface("/p", "x/fixtures/f.py", seq=3), surface("/o", seq=4)]
    s = flagged(spark.createDataFrame(rows, SURFACE))
    assert [r["class"] for r in s.orderBy("seq").select(review.evidence_class().alias("class")).collect()] == ["inferred_protocol", "observed_runtime_internal", "low_quality", "observed_runtime_public"]
    assert review.evidence_counts(s).select(review.basis()).first()[0] == "observed"


def test_finding_without_related_surface_falls_back_to_all(spark):
    s = flagged(spark.createDataFrame([surface("/x", "tests/z.py")], SURFACE))
    f = spark.createDataFrame([("r", "upload", "Other", "low", "low", "e")], FINDING)
    assert review.with_basis(f, s).first()["basis"] == "low_quality"
    p = spark.createDataFrame([], PATH)
    # 2*1 + 2*1 + 1.5*1 + 2*1 + 1.2*0.5 + 1.5*1 - 8, counted by hand; the evidence itself names no test folder.
    assert review.finding_scores(f, s, p).first()["score"] == 1.6


def test_paths_join_by_route_of_related_surface(spark):
    s = flagged(spark.createDataFrame([surface("/pay")], SURFACE))
    f = spark.createDataFrame([("r", "admin", "T", "high", "high", "GET /pay in a.py | confidence=0.25")], FINDING)
    p = spark.createDataFrame([("r", 1, "k", "one", ["Entry: GET /pay"]), ("r", 2, "k", "two", ["Entry: GET /other"])], PATH)
    assert [r.name for r in review.related_paths(f, s, p).collect()] == ["one"]


def test_reasons_keep_order_in_ties(spark):
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in (("a", 2.0), ("b", 3.0), ("c", 2.0), ("d", -1.0))))
    assert spark.range(1).select(review.top_reasons(listed, 3)).first()[0] == "b=3.0, a=2.0, c=2.0"


def test_documents_have_their_sections(spark, tmp_path):
    docs = spark.createDataFrame([("r", json.dumps(dict.fromkeys(reports.PACK_SECTIONS, 1))), ("q", "{}"), ("n", None)], "repo string, pack string")
    got = {r.repo: r.missing for r in reports.missing_sections(docs, "pack", reports.PACK_SECTIONS).collect()}
    assert set(got) == {"q", "n"} and got["q"] == list(reports.PACK_SECTIONS)
    reports.write_documents(str(tmp_path), "pack", docs, "pack")
    assert json.loads(next((tmp_path / "pack" / "repo=r").glob("*.txt")).read_text())["review"] == 1


def test_parts_of_a_document_are_written_by_themselves(spark):
    a = plans.analysis(spark, "/root/testdata/sf0.001")
    for df in (review.review_json(a.clean, a.surfaces, a.findings, a.paths), review.evidence_pack(a.clean, a.surfaces, a.findings, a.paths)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Window", "Aggregate", "Generate"))


def test_control_patterns_are_tried_once_on_what_is_said_often(spark, monkeypatch):
    seen, settled = [], protection.settled
    monkeypatch.setattr(protection, "settled", lambda df, name: seen.append(df) or settled(df, name))
    a = plans.analysis(spark, "/root/testdata/sf0.001")
    assert protection.present_controls(a.clean).count()
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate") :]
