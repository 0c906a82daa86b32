"""Command line.

    python -m factloom analyze TREE OUT    scans source files and writes tables, documents, reports and the summary
    python -m factloom tables DATA OUT     the same from a directory of the test tables
    python -m factloom modules             lists the analyzers, and those of a saved listing of packages
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from factloom import registry
from factloom.operators import extract, markdown, narrative, overlay, review, signals, surfaces, threats
from factloom.operators.signals import Result
from factloom.plans import queries
from factloom.sources import reports
from factloom.sources.staged import settled
from factloom.sources.trees import read_tree


def write(out: str, found: Result, analyzers: DataFrame | None = None, backend: str | None = None) -> None:
    """All that is derived of a result, below the folder out."""
    scan = found.scan
    clean = signals.auth_filtered(scan)
    surf = settled(surfaces.classified(clean), "surfaces")
    findings = settled(threats.generate_findings(clean, surf), "findings")
    paths = settled(threats.generate_attack_paths(scan, surfaces.classified(scan)), "paths")
    assets = settled(overlay.detect_assets(clean), "assets")
    controls = settled(overlay.detect_controls(clean, surf, assets), "controls")
    insights = settled(overlay.insight_techniques(overlay.generate_insights(clean, surf, paths, assets, controls)), "insights")
    known = settled(overlay.finding_techniques(findings), "known_findings")
    opportunities = settled(overlay.detection_opportunities(insights, known), "opportunities")
    whole = overlay.Overlay(assets, controls, insights, known, opportunities)
    relations = {"routes": scan.route, "external_calls": scan.external_call, "databases": scan.database_hint, "hints": scan.hint, "secrets": scan.secret_hint, "meta": found.meta}
    derived = {"surfaces": surfaces.expanded(surf, clean), "findings": known, "paths": paths, "assets": assets, "controls": controls, "insights": insights, "opportunities": opportunities}
    reports.write_tables(out, **relations, **derived, summary=reports.console_summary(findings, paths))
    each = f"{out}/reports"  # a folder for each repository, with files of these names
    documents = settled(review.review_json(clean, surf, findings, paths), "review")
    reports.write_named(each, "defensive-review.json", documents, "review")
    reports.write_named(each, "review-context-pack.json", review.context_pack(clean, documents, analyzers), "pack")
    for name, lines in (
        ("architecture.md", markdown.architecture(scan, found.meta)),
        ("attack-surface.md", markdown.attack_surface(clean, surf)),
        ("defensive-review.md", markdown.review(clean, surf, findings, paths, whole, found.meta)),
    ):
        reports.write_named(each, name, markdown.rendered(lines), "text")
    if backend:
        told = settled(narrative.narrated(review.prompts(review.evidence_pack(clean, surf, findings, paths)), narrative.backend_of(backend), backend), "narratives")
        reports.write_named(each, "narrative-review.md", told.where("narrative is not null"), "narrative")
        reports.write_named(each, "narrative-review.json", told, "meta")
    for line in reports.console_lines(found, findings, paths):
        print(line)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze", help="scan a tree of source files")
    analyze.add_argument("tree")
    analyze.add_argument("--each", action="store_true", help="every folder in TREE is a repository")
    analyze.add_argument("--module", action="append", default=[], help="an analyzer to run; may be given again; else all that detect")
    tables = commands.add_parser("tables", help="analyze the relations made of the test tables")
    tables.add_argument("data")
    for p in (analyze, tables):
        p.add_argument("out", help="folder for tables, documents and reports")
        p.add_argument("--backend", help="module:function that writes a narrative from a system and a user prompt")
    modules = commands.add_parser("modules", help="list analyzers")
    modules.add_argument("--listing", help="a saved JSON listing of an organisation's repositories")
    given = parser.parse_args(args)
    if given.command == "modules":
        for a in registry.registered():
            m = registry.metadata_of(a.metadata)
            print(f"- {m.name}: {m.description}\n  scope: {m.scope}\n  ecosystems: {', '.join(m.ecosystems) or 'none'}")
        if given.listing:
            try:
                with open(given.listing, encoding="utf-8") as f:
                    found = registry.remote(f.read())
            except (OSError, ValueError) as failure:
                print(f"the listing can't be read: {failure}", file=sys.stderr)
                return 1
            for r in found:
                print(f"- {r['name']} ({r['package']}) {r['link']}".rstrip())
        return 0
    if given.backend:
        try:
            narrative.backend_of(given.backend)
        except (ImportError, ValueError) as failure:
            parser.error(str(failure))
    spark = SparkSession.builder.config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    if given.command == "tables":
        scan = queries.analysis(spark, given.data).scan
        write(given.out, Result(scan, extract.scanned(scan.route.selectExpr("repo", "'' AS suffix", "file").limit(0))), None, given.backend)
        return 0
    if not os.path.isdir(given.tree):
        parser.error(f"{given.tree} isn't a folder")
    try:
        analyzers = registry.selected(given.module) or registry.registered()
    except ValueError as failure:
        parser.error(str(failure))
    write(given.out, registry.analyze(read_tree(spark, given.tree, given.each), analyzers), registry.listing(spark, analyzers), given.backend)
    return 0


if __name__ == "__main__":
    sys.exit(main())
