"""Registered queries of the review evaluation: reviews made of the conversations, rubrics of several demands, oracles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import rubric
from factloom.plans.oracles import q

#: Made rubrics, each for the conversations of one remainder; the words are ones that made reviews have, or lack, in part.
DEMANDS = (
    {
        "grounding": {"allowed_ids": [f"surface:{i}" for i in range(1, 5)], "min_citations": 2},
        "observed_inferred": {"min_observed": 2, "min_inferred": 1},
        "strengths": {"min_items": 1, "required_keywords": ["Latch"]},
        "weaknesses_hotspots": {"min_items": 1, "required_terms": ["leak"]},
        "recommendations": {"min_items": 1, "action_verbs": ["sign", "rotate"]},
        "false_positive_control": {"banned_phrases": ["surely broken"], "required_cautions": ["by name"]},
    },
    {
        "grounding": {"citation_pattern": "finding:[0-9]+", "allowed_ids": ["finding:1", "finding:2"], "min_citations": 1},
        "observed_inferred": {"observed_token": "observed|seen", "inferred_token": "inferred", "min_observed": 3, "min_inferred": 2},
        "strengths": {"min_items": 2, "required_keywords": []},
        "weaknesses_hotspots": {"min_items": 0, "required_terms": ["leak", "door"]},
        "recommendations": {"min_items": 0, "action_verbs": ["rotate"]},
        "false_positive_control": {"banned_phrases": [], "required_cautions": ["NOT RUN", "by name"]},
    },
    {"recommendations": {"min_items": 0, "action_verbs": ["limit", "seal"]}, "false_positive_control": {"banned_phrases": ["definite"]}},
)
LACKING = 7  # conversations of so many have no review
HEADS = ("Strengths", "Weaknesses / Risk Hotspots", "Prioritized Recommendations", "System Overview")

#: A turn as part of a review; the same text in Spark and in the oracle.
TURN = """concat('## ', CASE turn % 4 WHEN 0 THEN 'Strengths' WHEN 1 THEN 'Weaknesses / Risk Hotspots' WHEN 2 THEN 'Prioritized Recommendations' ELSE 'System Overview' END,
  CASE WHEN conv_id % 5 = 0 THEN '  ' ELSE '' END, '\n',
  CASE WHEN turn % 3 = 0 THEN '- OBSERVED: a latch' WHEN turn % 3 = 1 THEN '  - inferred leak at the door' ELSE 'no bullet, but seen' END, ' [', CASE WHEN conv_id % 3 = 1 THEN 'finding:' ELSE 'Surface:' END, turn % 6 + 1, ']\n',
  CASE WHEN turn % 4 = 2 THEN CASE WHEN conv_id % 2 = 0 THEN '- Sign it, limit it\n' ELSE '- 1. Rotate keys\n' END WHEN turn % 4 = 3 THEN 'It was not run; some is told by name.\n' ELSE '- surface:1 was Observed' END,
  CASE WHEN conv_id % 11 = 3 THEN '\nIt is surely broken, definite.\n' ELSE '\n' END)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review for each conversation, its turns under headings, with the rubric of its remainder."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null").select("conv_id", "turn", F.expr(TURN).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), "")
    reviews = turns.groupBy("conv_id").agg(text.alias("text"))
    demands = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DEMANDS)], "kind int, demand string").select("kind", F.from_json("demand", rubric.EXPECTATIONS).alias("expectations"))
    named = reviews.select("conv_id", F.when(F.col("conv_id") % LACKING != 0, F.col("text")).alias("text"), (F.col("conv_id") % len(DEMANDS)).cast("int").alias("kind"))
    return named.join(F.broadcast(demands), "kind").select("conv_id", F.concat(F.lit("fixture-"), "conv_id").alias("fixture_id"), "text", "expectations")


def demand_sql() -> str:
    """The rubrics as rows of plain columns."""
    listed = lambda xs: "[" + ", ".join(map(q, xs or [])) + "]::VARCHAR[]"
    rows = []
    for i, d in enumerate(DEMANDS):
        get = lambda k, f, default=None: d.get(k, {}).get(f, default)  # noqa: E731, B023
        rows.append(
            f"SELECT {i} AS kind, {q(get('grounding', 'citation_pattern', rubric.CITATION))} AS pattern, {listed(get('grounding', 'allowed_ids'))} AS allowed,"
            f" {get('grounding', 'min_citations', 0)} AS least, "
            f"{q(get('observed_inferred', 'observed_token', rubric.OBSERVED))} AS seen, {q(get('observed_inferred', 'inferred_token', rubric.INFERRED))} AS guessed, "
            f"{get('observed_inferred', 'min_observed', 0)} AS least_seen, {get('observed_inferred', 'min_inferred', 0)} AS least_guessed, "
            f"{get('strengths', 'min_items', 0)} AS ns, {listed(get('strengths', 'required_keywords'))} AS ws, {get('weaknesses_hotspots', 'min_items', 0)} AS nw,"
            f" {listed(get('weaknesses_hotspots', 'required_terms'))} AS ww, "
            f"{get('recommendations', 'min_items', 0)} AS nr, {listed(get('recommendations', 'action_verbs'))} AS wr, "
            f"{listed(get('false_positive_control', 'banned_phrases'))} AS banned, {listed(get('false_positive_control', 'required_cautions'))} AS cautions"
        )
    return " UNION ALL ".join(rows)


def matches(pattern: str) -> str:
    """Matches of a pattern that is a column: patterns must be constants here, so one branch for each."""
    seen = sorted({d.get("grounding", {}).get("citation_pattern", rubric.CITATION) for d in DEMANDS} | {d.get("observed_inferred", {}).get(k, v) for d in DEMANDS for k, v in (("observed_token", rubric.OBSERVED), ("inferred_token", rubric.INFERRED))})
    return f"CASE {pattern} " + " ".join(f"WHEN {q(p)} THEN regexp_extract_all(text, {q('(?i)' + p)})" for p in seen) + " END"


def part(heading: str) -> str:
    """The first part after a heading: the text is cut at headings, and a part's first line says which it is."""
    cut = "string_split_regex('\n' || text, '\n[ \t]*##[ \t]+')"
    return f"coalesce(trim(regexp_replace(list_filter({cut}, lambda p: trim(split_part(p, '\n', 1)) = {q(heading)})[1], '^[^\n]*', ''), ' \n\t'), '')"


def items(section: str) -> str:
    return f"len(list_filter(string_split({section}, '\n'), lambda x: starts_with(trim(x, ' \t'), '- ')))"


def lacking(words: str, said: str) -> str:
    return f"len(list_filter({words}, lambda w: NOT contains(lower({said}), lower(w)))) = 0"


def holding(words: str, said: str) -> str:
    return f"len(list_filter({words}, lambda w: contains(lower({said}), lower(w)))) > 0"


SQL = f"""
WITH reviews AS (SELECT conv_id, string_agg({TURN}, '' ORDER BY turn, {TURN}) AS text FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
demands AS ({demand_sql()}),
cut AS (SELECT *, {part(HEADS[0])} AS s, {part(HEADS[1])} AS w, {part(HEADS[2])} AS r, list_distinct({matches("pattern")}) AS cited FROM reviews JOIN demands ON kind = conv_id % {len(DEMANDS)} WHERE conv_id % {LACKING} <> 0),
tested AS (SELECT conv_id,
  len(cited) >= least AND (len(allowed) = 0 OR len(list_filter(cited, lambda x: NOT list_contains(allowed, x))) = 0) AS grounding,
  len({matches("seen")}) >= least_seen AND len({matches("guessed")}) >= least_guessed AS observed_vs_inferred_discipline,
  {items("s")} >= ns AND {lacking("ws", "s")} AS strengths_coverage, {items("w")} >= nw AND {lacking("ww", "w")} AS weakness_hotspot_quality,
  {items("r")} >= nr AND {holding("wr", "r")} AS recommendation_usefulness, NOT ({holding("banned", "text")}) AND {lacking("cautions", "text")} AS false_positive_control FROM cut),
results AS (SELECT *, {" + ".join(f"{k}::INTEGER" for k in rubric.CHECKS)} AS passed_checks, 6 AS total_checks FROM tested
  UNION ALL SELECT conv_id, {", ".join("NULL" for _ in rubric.CHECKS)}, 0, 1 FROM reviews WHERE conv_id % {LACKING} = 0),
scored AS (SELECT *, 'fixture-' || conv_id AS fixture_id, round_even(passed_checks * 100::DOUBLE / total_checks, 2) AS score, CASE WHEN passed_checks = total_checks THEN 'pass' ELSE 'fail' END AS status FROM results)
"""
#: Names of the queries, by check.
NAMES = {
    "evl_grounding": "grounding",
    "evl_observed_inferred": "observed_vs_inferred_discipline",
    "evl_strengths": "strengths_coverage",
    "evl_weaknesses": "weakness_hotspot_quality",
    "evl_recommendations": "recommendation_usefulness",
    "evl_false_positive": "false_positive_control",
}


def register(queries: dict, oracles: dict) -> None:
    for name, check in NAMES.items():
        queries[name] = lambda spark, sf_dir, k=check: rubric.evaluate(cases(spark, sf_dir)).select("fixture_id", k)
        oracles[name] = SQL + f"SELECT fixture_id, {check} FROM scored"
    queries["evl_section"] = lambda spark, sf_dir: cases(spark, sf_dir).where("text is not null").select("fixture_id", *(rubric.section(F.col("text"), h).alias(k) for k, h in rubric.HEADINGS.items()))
    oracles["evl_section"] = SQL + "SELECT 'fixture-' || conv_id AS fixture_id, s AS strengths, w AS weaknesses, r AS recommendations FROM cut"
    queries["evl_bullets"] = lambda spark, sf_dir: rubric.evaluate(cases(spark, sf_dir)).where("text is not null").select("fixture_id", "n_strengths", "n_weaknesses", "n_recommendations")
    oracles["evl_bullets"] = SQL + (
        f"SELECT 'fixture-' || conv_id AS fixture_id, {items('s')}::INTEGER AS n_strengths, {items('w')}::INTEGER AS n_weaknesses, {items('r')}::INTEGER"
        f" AS n_recommendations FROM cut"
    )
    queries["evl_score"] = lambda spark, sf_dir: rubric.evaluate(cases(spark, sf_dir)).select("fixture_id", "score", "passed_checks", "total_checks", "status")
    oracles["evl_score"] = SQL + "SELECT fixture_id, score, passed_checks, total_checks, status FROM scored"
    queries["evl_suite"] = lambda spark, sf_dir: rubric.suite(rubric.evaluate(cases(spark, sf_dir)))
    oracles["evl_suite"] = (
        SQL + "SELECT count(*) AS fixture_count, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status <> 'pass') AS failed, "
        "round_even(sum(score) / count(*), 2) AS average_score, CASE WHEN count(*) > 0 AND bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END AS status FROM scored"
    )
