"""The rubric over files: headings, words and minima come from the rubric, a missing review is a failing case."""

import json

import pytest

from factloom import evaluate
from factloom.operators import rubric

GOOD = """# Review
## System Overview
- OBSERVED: uploads come in by one handler [surface:4] [path:5].
- INFERRED: a worker reads the queue [surface:12].

## Strengths
- OBSERVED: the queue is behind its own door [surface:7].
  - OBSERVED: tokens expire [finding:3].

## Weaknesses / Risk Hotspots
- an upload is kept by its given name [surface:4]
- a tenant is read from the body [finding:3]

### A heading of the third level
- callbacks can be sent as a replay

## Prioritized Recommendations
- 1. Sign callbacks.
-not a bullet

## Notes
- the code was not run; some marks are told by name alone
"""
RUBRIC = {
    "fixture_id": "good",
    "target": {"repo": "x"},
    "expectations": {
        "grounding": {"allowed_ids": ["surface:4", "surface:7", "surface:12", "finding:3", "path:5"], "min_citations": 5},
        "observed_inferred": {"min_observed": 2, "min_inferred": 1},
        "strengths": {"min_items": 2, "required_keywords": ["Queue", "tokens"]},
        "weaknesses_hotspots": {"min_items": 3, "required_terms": ["upload", "tenant", "replay"]},
        "recommendations": {"min_items": 1, "action_verbs": ["sign"]},
        "false_positive_control": {"banned_phrases": ["surely broken"], "required_cautions": ["name alone", "not run"]},
    },
}


@pytest.fixture()
def folders(tmp_path):
    rubrics, reviews = tmp_path / "rubrics", tmp_path / "reviews"
    rubrics.mkdir()
    reviews.mkdir()

    def put(stem, spec, text=None, file=None):
        (rubrics / f"{stem}.json").write_text(json.dumps(spec, indent=1))
        if text is not None:
            (reviews / (file or f"{stem}.md")).write_text(text)

    return put, str(rubrics), str(reviews)


def test_suite_of_files(spark, folders, capsys):
    put, rubrics, reviews = folders
    put("good", RUBRIC, GOOD)
    assert evaluate.main([rubrics, reviews]) == 0
    put("named", RUBRIC | {"fixture_id": "named", "review_file": "other name.md"}, GOOD.replace("Sign", "Consider") + "surely BROKEN [surface:9]", "other name.md")
    put("lost", {"expectations": {}})
    capsys.readouterr()
    assert evaluate.main([rubrics, reviews, "--json"]) == 1
    got = json.loads(capsys.readouterr().out)
    assert got["suite"] == {"fixture_count": 3, "passed": 1, "failed": 2, "average_score": 50.0, "status": "fail"}
    by = {c["fixture_id"]: c for c in got["cases"]}
    assert by["good"]["score"] == 100.0 and by["named"]["passed_checks"] == 3
    assert [c["name"] for c in by["named"]["checks"] if not c["passed"]] == ["grounding", "recommendation_usefulness", "false_positive_control"]
    assert by["lost"]["checks"] == [{"name": rubric.MISSING, "passed": False}] and by["lost"]["total_checks"] == 1


def test_one_pair_and_bad_arguments(spark, folders, capsys):
    put, rubrics, reviews = folders
    put("good", RUBRIC | {"review_file": "elsewhere.md"}, GOOD)
    assert evaluate.main([f"{rubrics}/good.json", f"{reviews}/good.md"]) == 0
    with pytest.raises(SystemExit):
        evaluate.main([rubrics, f"{reviews}/good.md"])


def test_what_a_rubric_leaves_out_asks_for_nothing(spark):
    rows = spark.createDataFrame([(1, "", "{}"), (2, None, "{}"), (3, "## Prioritized Recommendations\n- limit", '{"recommendations": {"action_verbs": ["limit"]}}')], "i int, text string, e string")
    cases = rows.selectExpr("i", "text", f"from_json(e, '{rubric.EXPECTATIONS}') AS expectations")
    got = {r.i: (r.passed_checks, r.total_checks, r.status) for r in rubric.evaluate(cases).collect()}
    assert got == {1: (5, 6, "fail"), 2: (0, 1, "fail"), 3: (6, 6, "pass")}  # without verbs no recommendation is useful
    assert rubric.suite(rubric.evaluate(cases.limit(0)).withColumn("fixture_id", rows.i.cast("string"))).first().status == "fail"
