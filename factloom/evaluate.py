"""Command line: python -m factloom.evaluate RUBRICS REVIEWS scores reviews; the exit code is 0 if all pass, else 1.

RUBRICS and REVIEWS are folders, or one JSON and one markdown file, which then belong together.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom.operators import rubric


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom.evaluate")
    parser.add_argument("rubrics", help="folder of rubric files, or one")
    parser.add_argument("reviews", help="folder of reviews, or one")
    parser.add_argument("--json", action="store_true", help="print the whole result as JSON")
    given = parser.parse_args(args)
    one = given.rubrics.endswith(".json")
    if one != given.reviews.endswith(".md"):
        parser.error("give two folders, or a .json and a .md file")
    spark = SparkSession.builder.config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    rubrics, reviews = rubric.load_rubrics(spark, given.rubrics), rubric.load_reviews(spark, given.reviews)
    pairs = rubrics.join(reviews.select("text"), F.lit(True), "left") if one else rubric.paired(rubrics, reviews)
    done = rubric.evaluate(pairs).persist()
    cases = sorted((r.asDict(recursive=True) for r in rubric.case_results(done).collect()), key=lambda r: r["fixture_id"])  # a row for each rubric file
    total = rubric.suite(done).first().asDict()
    done.unpersist()
    if given.json:
        print(json.dumps({"suite": total, "cases": cases}, indent=2, sort_keys=True))
    else:
        print(f"rubrics: {total['fixture_count']}, passed: {total['passed']}, failed: {total['failed']}, average score: {total['average_score']}, {total['status']}")
        for r in cases:
            failing = ", ".join(c["name"] for c in r["checks"] if not c["passed"])
            print(f"- {r['fixture_id']}: {r['status']} ({r['score']})" + (f"; failing: {failing}" if failing else ""))
    return 0 if total["status"] == "pass" else 1


if __name__ == "__main__":
    sys.exit(main())
