"""Review evaluation: six checks of a markdown review against a rubric, natively over one row for each pair.

A rubric is JSON: an id, the name of its review file, and what it expects (``EXPECTATIONS``). Every minimum, word, phrase
and pattern comes from it; what it leaves out asks for nothing. Sections run from their heading to the next one of the
second level; bullets are lines that begin with "- ". A rubric whose review is missing is a failing case of one check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the checks, headings of the sections they read, patterns used where a rubric has none.
CHECKS = ("grounding", "observed_vs_inferred_discipline", "strengths_coverage", "weakness_hotspot_quality", "recommendation_usefulness", "false_positive_control")
HEADINGS = {"strengths": "Strengths", "weaknesses": "Weaknesses / Risk Hotspots", "recommendations": "Prioritized Recommendations"}
CITATION, OBSERVED, INFERRED = r"(?:surface|finding|path):\d+", r"\bOBSERVED\b", r"\bINFERRED\b"
MISSING = "review_file_presence"

EXPECTATIONS = """struct<
  grounding: struct<citation_pattern: string, allowed_ids: array<string>, min_citations: int>,
  observed_inferred: struct<observed_token: string, inferred_token: string, min_observed: int, min_inferred: int>,
  strengths: struct<min_items: int, required_keywords: array<string>>,
  weaknesses_hotspots: struct<min_items: int, required_terms: array<string>>,
  recommendations: struct<min_items: int, action_verbs: array<string>>,
  false_positive_control: struct<banned_phrases: array<string>, required_cautions: array<string>>>"""
RUBRIC = f"schema_version string, fixture_id string, target map<string, string>, review_file string, expectations {EXPECTATIONS}"


def load_rubrics(spark: SparkSession, folder: str) -> DataFrame:
    """Rubrics of a folder's JSON files: stem (the file's name), and what the file holds."""
    rows = spark.read.schema(RUBRIC).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1)
    return rows.select(F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))).alias("stem"), "*")


def load_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """review_file, text of a folder's markdown files, each whole."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)
    return rows.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("review_file"), F.col("value").alias("text"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def section(text: Column, heading: str) -> Column:
    """Text between "## heading" and the next heading of that level, trimmed; empty if there is none."""
    return strip(F.regexp_extract(text, rf"(?ms)^\s*##\s+\Q{heading}\E\s*$(.*?)(?=^\s*##\s+[^\n]+$|\z)", 1))


def bullets(text: Column) -> Column:
    """The lines that begin with "- ", without it."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), strip), lambda x: x.startswith("- "))
    return F.transform(lines, lambda x: strip(F.substring(x, F.lit(3), F.length(x))))


def listed(expected: Column) -> Column:
    return F.coalesce(expected, F.array().cast("array<string>"))


def lowered(expected: Column) -> Column:
    return F.transform(listed(expected), F.lower)


def least(expected: Column) -> Column:
    return F.coalesce(expected, F.lit(0))


def found(text: Column, pattern: Column) -> Column:
    """Matches of a row's own pattern, in any case."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?i)"), pattern), F.lit(0))


def details(text: Column, e: Column) -> dict[str, Column]:
    """What the checks look at."""
    low = F.lower(text)
    cited = F.array_sort(F.array_distinct(found(text, F.coalesce(e["grounding"]["citation_pattern"], F.lit(CITATION)))))
    allowed = listed(e["grounding"]["allowed_ids"])
    parts = {k: section(text, h) for k, h in HEADINGS.items()}
    within = lambda words, said: F.filter(lowered(words), lambda w: said.contains(w))
    without = lambda words, said: F.filter(lowered(words), lambda w: ~said.contains(w))
    return {
        "citations": cited,
        "unknown_citations": F.when(F.size(allowed) > 0, F.array_except(cited, allowed)).otherwise(F.array().cast("array<string>")),
        "n_observed": F.size(found(text, F.coalesce(e["observed_inferred"]["observed_token"], F.lit(OBSERVED)))),
        "n_inferred": F.size(found(text, F.coalesce(e["observed_inferred"]["inferred_token"], F.lit(INFERRED)))),
        "n_strengths": F.size(bullets(parts["strengths"])),
        "missing_keywords": without(e["strengths"]["required_keywords"], F.lower(parts["strengths"])),
        "n_weaknesses": F.size(bullets(parts["weaknesses"])),
        "missing_terms": without(e["weaknesses_hotspots"]["required_terms"], F.lower(parts["weaknesses"])),
        "n_recommendations": F.size(bullets(parts["recommendations"])),
        "verbs": within(e["recommendations"]["action_verbs"], F.lower(parts["recommendations"])),
        "banned": within(e["false_positive_control"]["banned_phrases"], low),
        "missing_cautions": without(e["false_positive_control"]["required_cautions"], low),
    }


def evaluate(cases: DataFrame) -> DataFrame:
    """Cases (text, expectations and more columns) with the checks, what they looked at, score (the share passed in percent,
    halves to even), passed_checks, total_checks and status. A null text is a missing review."""
    e, c = F.col("expectations"), F.col
    there = c("text").isNotNull()
    rows = cases.withColumns(details(F.coalesce("text", F.lit("")), e))
    tests = {
        "grounding": (F.size("citations") >= least(e["grounding"]["min_citations"])) & (F.size("unknown_citations") == 0),
        "observed_vs_inferred_discipline": (c("n_observed") >= least(e["observed_inferred"]["min_observed"])) & (c("n_inferred") >= least(e["observed_inferred"]["min_inferred"])),
        "strengths_coverage": (c("n_strengths") >= least(e["strengths"]["min_items"])) & (F.size("missing_keywords") == 0),
        "weakness_hotspot_quality": (c("n_weaknesses") >= least(e["weaknesses_hotspots"]["min_items"])) & (F.size("missing_terms") == 0),
        "recommendation_usefulness": (c("n_recommendations") >= least(e["recommendations"]["min_items"])) & (F.size("verbs") > 0),
        "false_positive_control": (F.size("banned") == 0) & (F.size("missing_cautions") == 0),
    }
    rows = rows.withColumns({k: F.when(there, F.coalesce(t, F.lit(False))) for k, t in tests.items()})
    n = sum((F.coalesce(c(k), F.lit(False)).cast("int") for k in CHECKS), F.lit(0))
    total = F.when(there, len(CHECKS)).otherwise(1)
    rows = rows.withColumns({"passed_checks": n, "total_checks": total})
    score = F.bround(c("passed_checks") * F.lit(100.0) / c("total_checks"), 2)
    return rows.withColumns({"score": score, "status": F.when(c("passed_checks") == c("total_checks"), "pass").otherwise("fail")})


def paired(rubrics: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each rubric with the text of its review (null if there is none): of the file it names, else of its own stem."""
    named = strip(F.coalesce("review_file", F.lit("")))
    wanted = F.when(named != "", named).otherwise(F.concat("stem", F.lit(".md")))
    return rubrics.withColumn("review_file", wanted).join(reviews, "review_file", "left")


def case_results(evaluated: DataFrame) -> DataFrame:
    """fixture_id, score, passed_checks, total_checks, status, checks (array of name and passed) of evaluated pairs."""
    checks = F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("passed")) for k in CHECKS))
    alone = F.array(F.struct(F.lit(MISSING).alias("name"), F.lit(False).alias("passed")))
    own = F.when(F.col("text").isNotNull(), checks).otherwise(alone)
    return evaluated.select(F.coalesce("fixture_id", "stem").alias("fixture_id"), "score", "passed_checks", "total_checks", "status", own.alias("checks"))


def suite(evaluated: DataFrame) -> DataFrame:
    """One row: fixture_count, passed, failed, average_score (halves to even), status; without any case it fails."""
    passed = F.count_if(F.col("status") == "pass")
    rows = evaluated.agg(F.count("*").alias("fixture_count"), passed.alias("passed"), F.coalesce(F.bround(F.sum("score") / F.count("*"), 2), F.lit(0.0)).alias("average_score"))
    good = (F.col("fixture_count") > 0) & (F.col("passed") == F.col("fixture_count"))
    return rows.select("fixture_count", "passed", (F.col("fixture_count") - F.col("passed")).alias("failed"), "average_score", F.when(good, "pass").otherwise("fail").alias("status"))
