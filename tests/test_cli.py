"""The command line over a tree: everything is written for every repository, and bad arguments say what is wrong."""

import json
import os

import pytest

from factloom import __main__ as cli
from factloom.operators import narrative, review
from factloom.sources import reports
from factloom.sources.reports import PACK_SECTIONS, REVIEW_SECTIONS

APP = """from fastapi import FastAPI
app = FastAPI()
@app.post("/webhooks/pay")
def pay(): requests.post("https://pay.example.com/x")
@app.get("/admin/users")
def users(): create_engine("postgresql://x")
KEY = os.getenv("JWT_SECRET")
"""


def texts(file):
    """By repository, the report of that name."""
    return {folder.name: (folder / file.name).read_text() for folder in (file.parent / "reports").iterdir() if (folder / file.name).exists()}


def test_named_files_are_whole_or_not_there(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one\r\n"), ("b/../c", "two"), ("..", None), (None, "lost")], "repo string, text string")
    for _ in range(2):  # once more over what is there
        reports.write_named(str(tmp_path / "r"), "x.md", rows, "text")
    assert {p.name: (p / "x.md").read_bytes() for p in (tmp_path / "r").iterdir()} == {"a": b"one\r\n", "b%2F..%2Fc": b"two", "%2E%2E": b""}
    assert all(len(list(p.iterdir())) == 1 for p in (tmp_path / "r").iterdir())
    failing = rows.where("repo = 'a'").selectExpr("repo", "raise_error('no') AS text")
    with pytest.raises(Exception, match="no"):
        reports.write_named(str(tmp_path / "f"), "x.md", failing, "text")
    assert not (tmp_path / "f" / "a" / "x.md").exists()


def test_analyze_writes_reports_of_every_repository(spark, tmp_path, capsys):
    for repo, text in (("shop", APP), ("idle", "x = 1\n")):
        (tmp_path / "trees" / repo).mkdir(parents=True)
        (tmp_path / "trees" / repo / "app.py").write_text(text)
    out = tmp_path / "out"
    assert cli.main(["analyze", str(tmp_path / "trees"), str(out), "--each", "--module", "python-web", "--backend", "posixpath:join"]) == 0
    said = capsys.readouterr().out
    assert "Repositories: 2; files scanned: 2; languages: python" in said and "shop: [HIGH]" in said
    reviews = {k: json.loads(v) for k, v in texts(out / "defensive-review.json").items()}
    packs = {k: json.loads(v) for k, v in texts(out / "review-context-pack.json").items()}
    assert set(reviews) == {"shop", "idle"} == set(packs) and set(REVIEW_SECTIONS) <= set(reviews["shop"]) and set(PACK_SECTIONS) <= set(packs["shop"])
    assert [a["name"] for a in packs["shop"]["analyzers"]] == ["python-web"]
    for name in ("architecture.md", "attack-surface.md", "defensive-review.md"):
        found = texts(out / name)
        assert set(found) == {"shop", "idle"} and found["shop"].startswith("# ")
    assert "- [HIGH] GET /admin/users (app.py)" in texts(out / "attack-surface.md")["shop"]
    assert "Languages: python" in texts(out / "architecture.md")["idle"]
    assert texts(out / "narrative-review.md")["shop"].startswith(review.SYSTEM + "/Repository: root=shop")
    assert {r.name for r in spark.read.parquet(str(out / "secrets")).collect()} == {"JWT_SECRET"}
    assert spark.read.parquet(str(out / "insights")).where("size(techniques) > 0").count() > 0


def test_bad_arguments(tmp_path, capsys):
    for args, said in (
        (["analyze", str(tmp_path / "none"), "out"], "isn't a folder"),
        (["analyze", str(tmp_path), "out", "--module", "cobol"], "no analyzers named cobol"),
        (["tables", "x", "out", "--backend", "nothing"], "isn't module:function"),
        ([], "required"),
    ):
        with pytest.raises(SystemExit):
            cli.main(args)
        assert said in capsys.readouterr().err


def test_modules_are_listed(tmp_path, capsys):
    listing = tmp_path / "listing.json"
    listing.write_text('[{"name": "factloom-analyzer-go", "html_url": "https://h/go"}]')
    assert cli.main(["modules", "--listing", str(listing)]) == 0
    said = capsys.readouterr().out
    assert "- python-web: " in said and "ecosystems: python, fastapi, flask" in said and "- go (factloom-analyzer-go) https://h/go" in said
    listing.write_text("{}")
    assert cli.main(["modules", "--listing", str(listing)]) == 1


def test_narratives_fail_one_by_one(spark):
    def fail(system, user):
        raise RuntimeError("busy")

    prompts = spark.createDataFrame([("a", "s", "Repository: a\n"), ("b", "s", "Repository: b\n")], "repo string, system string, user string")
    told = {r.repo: (r.narrative, json.loads(r.meta)["failure"]) for r in narrative.narrated(prompts, lambda s, u: "" if " b" in u else u).collect()}
    assert told == {"a": ("Repository: a\n", None), "b": (None, "the answer is empty")}
    assert {json.loads(r.meta)["failure"] for r in narrative.narrated(prompts, fail).collect()} == {"RuntimeError: busy"}


def test_keys_of_the_evidence_are_sorted(spark):
    rows = spark.createDataFrame([("r", 1, "x", "y")], "repo string, place int, zebra string, ant string")
    assert review.listed(rows, "n", "zebra", "ant").selectExpr("to_json(n) AS j").first().j == '[{"ant":"y","zebra":"x"}]'
