"""Markdown reports of each repository: architecture, attack surface, and the defensive review.

A report is a relation of lines (repo, part, place, line): every part has a heading, and a line of its own where it has
nothing to show. Lists are cut by row_number before a repository's lines are put together, so a report's size is bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.expressions import even, first_rows, location, low_quality, rank_of, sorted_set
from factloom.operators.chains import text
from factloom.operators.insights import ordered_insights
from factloom.operators.overlay import Overlay
from factloom.operators.protection import CRITICALITY, STRENGTHS
from factloom.operators.ranking import basis_label, entrypoint_class, path_scores, shares, surface_scores
from factloom.operators.review import finding_scores, mitigation, related_surfaces
from factloom.operators.signals import family
from factloom.operators.surfaces import RISKS, architecture_graph, expanded, traits
from factloom.operators.techniques import catalog, technique_use
from factloom.operators.threats import IMPACTS, SEVERITIES, finding_order
from factloom.sources.adapters import Scan
from factloom.sources.staged import settled, settled_together

# How many entries of each list a report shows, and the path score from which hops are to be validated.
SHOWN = {
    "strengths": 4,
    "findings": 3,
    "hotspots": 2,
    "lines": 12,
    "chains": 3,
    "actions": 4,
    "all_actions": 5,
    "assets": 8,
    "controls": 8,
    "absent": 6,
    "insights": 6,
    "opportunities": 5,
    "edges": 10,
    "routes": 10,
    "targets": 25,
}
STRONG_PATH = 22.0
# Headings of the reports.
ARCHITECTURE = ("# Architecture Summary", "## Overview", "## Entry Point Concentration", "## Likely Review Starting Point", "## Inferred Trust Boundaries", "## Analyst Notes")
SURFACE = (
    "# Attack Surface",
    "## Priority View",
    "## Highest-Risk Entry Points",
    "## Auth And Privileged Routes",
    "## Public Application Routes",
    "## Operational And Internal Routes",
    "## External Dependencies",
    "## Secrets And Auth Hints",
)
REVIEW = (
    "# Defensive Review",
    "## System Overview",
    "## Notable Observations",
    "## ATT&CK Techniques Mapped",
    "## Detection Opportunities",
    "## Asset Inventory",
    "## Defensive Controls",
    "## Strengths",
    "## Weaknesses / Risk Hotspots",
    "## Key Evidence Chains",
    "## Recommendations",
    "## Analyst Notes",
)

HOPS = "- Check every hop of the attack paths for authentication, authorization and the least rights its service needs."
TESTS = "- Test the riskiest routes and service edges, so that their guards don't get lost."
NOTES = ("- All of this is inferred from code by rules: a place to start, not a verdict.", "- Hold the top risks against the real architecture and what runs.")


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", even(x, 1))


def count_of(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("repo").agg(F.count("*").alias(name))


def joined(scan: Scan, *parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "repo", "left"), parts, scan.repo)


def numbered(rows: DataFrame, *lines: Column) -> DataFrame:
    """repo, place, line: several lines of each row (repo, place), null ones left out."""
    each = F.array_compact(F.array(*lines))
    return rows.select("repo", "place", F.posexplode(each).alias("i", "line")).select("repo", (F.col("place") * 10 + F.col("i")).alias("place"), "line")


def more(df: DataFrame, n: int, rest: str) -> DataFrame:
    """The line that tells how many rows beyond n a repository has."""
    left = count_of(df, "n").where(F.col("n") > n)
    return left.select("repo", F.lit(100_000).alias("place"), text("- …and ", (F.col("n") - n).cast("string"), rest).alias("line"))


# The lists of the defensive review


def strengths(scan: Scan, surfaces: DataFrame) -> DataFrame:
    """repo, place, line: the four statements with the highest scores; ties in the order given here."""
    c = F.col
    hints = family(scan, "auth").select("repo", "hint").distinct()
    few = first_rows(hints, ["repo"], ["hint"], 6).groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("hint")), ", ").alias("hints"))
    safe = F.col("guarded")
    of = surfaces.groupBy("repo").agg(F.count_if(safe).alias("safe"), F.count_if(c("exposure") == "internal").alias("internal"), F.count_if(c("risk") == "low").alias("low"))
    rows = joined(scan, few, count_of(hints, "n_hints"), of, count_of(scan.secret_hint, "n_secrets"))
    n = lambda k: F.coalesce(k, F.lit(0))
    item = lambda score, *parts: F.struct(score.cast("double").alias("score"), text(*parts).alias("line"))
    said = (
        F.when(n("n_hints") > 0, item(F.lit(9.0) + F.least(n("n_hints"), F.lit(5)), "- Signals of authentication or identity are in the code (", c("hints"), ").")),
        F.when(n("safe") > 0, item(F.lit(8.0) + F.least(n("safe"), F.lit(5)), "- ", c("safe").cast("string"), " route(s) have auth signals nearby.")),
        F.when(n("internal") > 0, item(F.lit(7.0), "- ", c("internal").cast("string"), " route(s) look internal, which limits exposure if they are kept apart.")),
        F.when(n("low") > 0, item(F.lit(6.0), "- ", c("low").cast("string"), " route(s) are operational and of low risk.")),
        F.when(n("n_secrets") > 0, item(F.lit(6.5), "- Secrets come from the environment, not from literals.")).otherwise(item(F.lit(5.0), "- No secret-like names are read from the environment.")),
    )
    listed = F.transform(F.array_compact(F.array(*said)), lambda x, i: F.struct((-x["score"]).alias("down"), i.alias("i"), x["line"].alias("line")))
    best = F.slice(F.array_sort(listed), 1, SHOWN["strengths"])
    return rows.select("repo", F.posexplode(best).alias("place", "x")).select("repo", "place", "x.line")


def related_shares(findings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Findings with label and provenance of their related surfaces."""
    stats = shares(related_surfaces(findings, surfaces), ["repo", "rule"])
    said = lambda k: F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"pct_{k}"), F.lit(0)).cast("string"), F.lit("%"))
    rows = findings.join(stats, ["repo", "rule"], "left")
    label = F.when(F.col("n").isNull(), "inferred-weak").otherwise(basis_label())
    return rows.select(*findings.columns, label.alias("label"), F.concat_ws(", ", *(said(k) for k in ("observed_runtime", "protocol_derived", "low_quality"))).alias("provenance"))


def scored_findings(findings: DataFrame, surfaces: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings (eleven at most a repository) with score, reasons, label and provenance."""
    return related_shares(finding_scores(findings, surfaces, paths), surfaces)


def weaknesses(scored: DataFrame, surfaces: DataFrame) -> DataFrame:
    """repo, place, line: three lines for each of the first findings by score, then for the first hotspots."""
    c = F.col
    top = first_rows(scored, ["repo"], [F.desc("score"), rank_of(c("severity"), SEVERITIES), *finding_order(), "rule"], SHOWN["findings"]).withColumnRenamed("rn", "place")
    said = numbered(top, text("- [", F.upper("severity"), " | score ", one_decimal(c("score")), "] ", c("title")), text("- Reason: ", c("reasons")), text("- Provenance: ", c("provenance")))
    pool = surfaces.withColumn("weak", low_quality(c("file")))
    best = pool.groupBy("repo").agg(F.min("weak").alias("least"))
    pool = surface_scores(pool.join(best, "repo").where("weak = least"))
    order = [F.desc("score"), rank_of(c("risk"), RISKS), F.desc("route"), "seq"]
    one = first_rows(pool, ["repo", "route", "file", "category", "exposure"], order).drop("rn")
    hot = first_rows(one, ["repo"], order, SHOWN["hotspots"]).withColumn("place", c("rn") + 100)
    own = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.when(c("provenance") == k, "100").otherwise("0"), F.lit("%")) for k in ("observed_runtime", "protocol_derived", "low_quality")))
    spots = numbered(
        hot,
        text("- Hotspot [score ", one_decimal(c("score")), "]: ", c("method"), " ", c("route"), " (", location(c("file"), c("line")), ") -> ", c("category"), " / ", c("risk")),
        text("- Reason: ", c("reasons")),
        text("- Provenance: ", own),
    )
    return first_rows(said.union(spots), ["repo"], ["place"], SHOWN["lines"]).select("repo", F.col("rn").alias("place"), "line")


def evidence_chains(paths: DataFrame) -> DataFrame:
    """repo, place, line: the first paths by score, with what made the score and their first step."""
    c = F.col
    top = first_rows(path_scores(paths), ["repo"], [F.desc("score"), c("place")], SHOWN["chains"]).drop("place").withColumnRenamed("rn", "place")
    impact = F.create_map(*(F.lit(x) for kv in IMPACTS.items() for x in kv))[c("kind")]
    return numbered(top, text("- [score ", one_decimal(c("score")), "] ", c("name"), ": ", impact), text("- Reason: ", c("reasons")), text("- Key step: ", F.get("steps", F.lit(0))))


def recommendations(scan: Scan, scored: DataFrame, paths: DataFrame) -> DataFrame:
    """repo, place, line: the mitigations of the findings by score, each once, those of low-quality evidence last and only up
    to four; then advice on hops if a path's score asks for it, and on tests; five lines at most."""
    c = F.col
    scored = scored.withColumn("line", text("- [", c("label"), "] ", mitigation()))
    weak = c("label") == "low-quality-evidence"
    order = [weak, F.desc("score"), *finding_order(), "rule"]
    once = first_rows(scored.where("line is not null"), ["repo", "line"], order).drop("rn")
    few = first_rows(once, ["repo"], order, SHOWN["actions"]).select("repo", F.col("rn").alias("place"), "line")
    strong = path_scores(paths).groupBy("repo").agg(F.max("score").alias("best")).where(F.col("best") >= STRONG_PATH)
    hops = strong.select("repo", F.lit(5).alias("place"), F.lit(HOPS).alias("line"))
    rows = few.union(hops).union(scan.repo.select("repo", F.lit(6), F.lit(TESTS)))
    return first_rows(rows, ["repo"], ["place"], SHOWN["all_actions"]).select("repo", F.col("rn").alias("place"), "line")


# Reports


def document(scan: Scan, headings: tuple[str, ...], parts: dict[int, tuple[DataFrame | None, tuple[str, ...]]]) -> DataFrame:
    """repo, part, place, line: headings, what parts show (repo, place, line), and their default lines where that is
    nothing. A part without default lines goes with its heading. Parts are written by
    themselves, which keeps plans short."""
    c = F.col
    held = settled_together({f"part{i}": shown.select("repo", "place", "line") for i, (shown, _) in parts.items() if shown is not None})
    parts = {i: (held.get(f"part{i}"), default) for i, (_, default) in parts.items()}
    title = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(h).alias("line")) for i, h in enumerate(headings) if i == 0 or parts[i][1]))
    rows = [scan.repo.select("repo", F.inline(title)).select("repo", "part", F.lit(-1).alias("place"), "line")]
    for i, (shown, default) in parts.items():
        if shown is not None:
            rows.append(shown.select("repo", F.lit(i).alias("part"), c("place").cast("int").alias("place"), "line"))
            if not default:
                rows.append(shown.select("repo").distinct().select("repo", F.lit(i), F.lit(-1), F.lit(headings[i])))
        if default:
            lone = scan.repo if shown is None else scan.repo.join(shown.select("repo").distinct(), "repo", "left_anti")
            rows.append(lone.select("repo", F.lit(i), F.explode(F.sequence(F.lit(0), F.lit(len(default) - 1))).alias("place")).withColumn("line", F.array(*map(F.lit, default))[c("place")]))
    return reduce(DataFrame.union, rows)


def rendered(lines: DataFrame) -> DataFrame:
    """repo, text: a report's lines in order, an empty one before each part."""
    line = F.when((F.col("place") == -1) & (F.col("part") > 0), F.concat(F.lit("\n"), "line")).otherwise(F.col("line"))
    order = F.array_sort(F.collect_list(F.struct("part", "place", line.alias("line"))))
    return lines.groupBy("repo").agg(F.concat(F.array_join(F.transform(order, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def sets(scan: Scan, meta: DataFrame | None) -> DataFrame:
    """repo and what overviews tell: counts, sorted sets as text, and of meta languages and files_scanned."""
    none = lambda k: F.coalesce(k, F.lit("none")).alias(k)
    listed = lambda df, column, name: df.groupBy("repo").agg(F.array_join(sorted_set(column), ", ").alias(name))
    parts = [
        count_of(scan.route, "routes"),
        count_of(scan.external_call, "calls"),
        count_of(scan.secret_hint, "secrets"),
        listed(scan.database_hint, "kind", "stores"),
        listed(scan.external_call, "target", "targets"),
        listed(family(scan, "auth"), "hint", "auth"),
    ]
    rows = joined(scan, *parts)
    if meta is None:
        rows = rows.withColumns({"languages": F.lit(None).cast("string"), "files_scanned": F.lit(None).cast("long")})
    else:
        rows = rows.join(meta.select("repo", F.when(F.size("languages") > 0, F.array_join("languages", ", ")).alias("languages"), "files_scanned"), "repo", "left")
    zero = [F.coalesce(k, F.lit(0)).alias(k) for k in ("routes", "calls", "secrets", "files_scanned")]
    return rows.select("repo", *zero, *(none(k) for k in ("stores", "targets", "auth", "languages")))


def shape(routes: Column) -> Column:
    return F.when(routes > 0, "web-facing").otherwise("non-web")


def architecture(scan: Scan, meta: DataFrame | None = None) -> DataFrame:
    """Lines of the architecture report."""
    c, s = F.col, lambda k: F.col(k).cast("string")
    overview = numbered(
        sets(scan, meta).withColumn("place", F.lit(0)),
        text("- A ", shape(c("routes")), " repository with ", s("routes"), " entry point(s)."),
        text("- Files scanned: ", s("files_scanned")),
        text("- Languages: ", c("languages")),
        text("- Datastores: ", c("stores")),
        text("- External targets: ", c("targets")),
        text("- Auth hints: ", c("auth")),
        text("- Secret-like names read from the environment: ", s("secrets")),
    )
    files = scan.route.groupBy("repo", "file").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    few = first_rows(files, ["repo"], [F.desc("n"), "seq"], 3)
    busiest = few.select("repo", F.col("rn").alias("place"), text("- ", c("file"), ": ", s("n"), " routes").alias("line"))
    start = few.where("rn = 1").select("repo", F.lit(0).alias("place"), text("- Begin with `", c("file"), "`, which holds ", s("n"), " of the routes.").alias("line"))
    nodes, edges = architecture_graph(scan)
    line = text(c("source"), " -> ", c("target"), " (", c("relation"), ")")
    first = first_rows(edges.select("repo", line.alias("edge")), ["repo"], ["edge"], SHOWN["edges"])
    bounds = first.select("repo", F.col("rn").alias("place"), text("- ", c("edge")).alias("line"))
    return document(scan, ARCHITECTURE, {1: (overview, ("",)), 2: (busiest, ()), 3: (start, ()), 4: (bounds, ()), 5: (None, NOTES)})


def attack_surface(scan: Scan, surfaces: DataFrame) -> DataFrame:
    """Lines of the attack surface report."""
    c, s = F.col, lambda k: F.col(k).cast("string")
    count = lambda on, name: F.count_if(on).alias(name)
    of = surfaces.groupBy("repo").agg(count(c("risk") == "high", "high"), count(c("exposure") == "public", "public"), count(c("exposure") == "internal", "internal"), count(c("data_store"), "data"), count(c("outbound"), "out"))
    rows = joined(scan, of).na.fill(0).withColumn("place", F.lit(0))
    view = numbered(
        rows,
        text("- High-risk entry points: ", s("high")),
        text("- Public routes: ", s("public")),
        text("- Internal routes: ", s("internal")),
        text("- Routes with data access: ", s("data")),
        text("- Routes with outbound calls: ", s("out")),
    )
    order = [rank_of(c("risk"), RISKS), "route", "method", "seq"]

    def listed(on: Column, level: bool = True) -> DataFrame:
        few = traits(expanded(first_rows(surfaces.where(on), ["repo"], order, SHOWN["routes"]), scan))
        where = text(c("method"), " ", c("route"), " (", c("file"), ") -> ", c("category"))
        line = text("- [", F.upper("risk"), "] ", where, ", ", c("exposure"), "; ", c("traits")) if level else text("- ", where, "; ", c("traits"))
        return few.select("repo", F.col("rn").alias("place"), line.alias("line"))

    targets = first_rows(scan.external_call.select("repo", "target").distinct(), ["repo"], ["target"], SHOWN["targets"]).select("repo", F.col("rn").alias("place"), text("- ", c("target")).alias("line"))
    secrets = first_rows(scan.secret_hint, ["repo"], ["seq"], SHOWN["targets"]).select("repo", F.col("rn").alias("place"), text("- Secret read from the environment: ", c("name"), " (", c("file"), ")").alias("line"))
    no_secret = scan.repo.join(scan.secret_hint.select("repo").distinct(), "repo", "left_anti").select("repo", F.lit(0).alias("place"), F.lit("- No secret-like names are read from the environment").alias("line"))
    hints = sets(scan, None).select("repo", F.lit(1000).alias("place"), F.when(c("auth") == "none", "- No auth hints").otherwise(text("- Auth hints: ", c("auth"))).alias("line"))
    guarded = c("category").isin("auth", "admin")
    return document(
        scan,
        SURFACE,
        {
            1: (view, ("",)),
            2: (listed(c("risk") == "high", level=False), ("- None is of high risk",)),
            3: (listed(guarded), ("- None is for authentication or administration",)),
            4: (listed((c("exposure") == "public") & ~c("category").isin("auth", "admin", "health")), ("- There are no other public routes",)),
            5: (listed(c("category").isin("health", "internal")), ("- None is operational or internal",)),
            6: (targets, ("- No literal outbound targets",)),
            7: (secrets.union(no_secret).union(hints), ("",)),
        },
    )


def review(scan: Scan, surfaces: DataFrame, findings: DataFrame, paths: DataFrame, overlay: Overlay, meta: DataFrame | None = None) -> DataFrame:
    """Lines of the defensive review."""
    c, s = F.col, lambda k: F.col(k).cast("string")
    entry = surfaces.withColumn("class", entrypoint_class())
    of = entry.groupBy("repo").agg(*(F.count_if(c("class") == k).alias(k) for k in ("runtime_public", "protocol_derived", "internal_only", "low_quality")))
    there = c("strength") != "absent"
    guards = overlay.controls.groupBy("repo").agg(F.count_if(there).alias("present"), F.count_if(~there).alias("missing"))
    rows = sets(scan, meta).join(of, "repo", "left").join(guards, "repo", "left").join(count_of(overlay.assets, "assets"), "repo", "left").na.fill(0).withColumn("place", F.lit(0))
    overview = numbered(
        rows,
        text("- A ", shape(c("routes")), " codebase with ", s("routes"), " entry point(s) in ", s("files_scanned"), " scanned files."),
        text("- Public at run time: ", s("runtime_public"), "; from protocols: ", s("protocol_derived"), "; internal: ", s("internal_only"), "; in tests and examples: ", s("low_quality")),
        text("- Languages: ", c("languages")),
        text("- Datastores: ", c("stores")),
        text("- External calls: ", s("calls")),
        text("- Assets: ", s("assets"), "; controls seen: ", s("present"), "; controls missed: ", s("missing")),
    )
    scored = settled(scored_findings(findings, surfaces, paths), "scored_findings")
    known = F.broadcast(catalog(scan.repo.sparkSession).select("technique", F.col("name").alias("technique_name")))  # sixteen rows
    placed = ordered_insights(overlay.insights)
    shown = placed.where(c("place") <= SHOWN["insights"])
    named = shown.select("repo", "place", F.posexplode(F.slice("techniques", 1, 4)).alias("i", "technique")).join(known, "technique")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text("`", c("technique"), "` ", c("technique_name")).alias("t")))), lambda x: x["t"]), ", ")
    told = shown.join(named.groupBy("repo", "place").agg(listed.alias("named")), ["repo", "place"], "left")
    observations = numbered(
        told,
        text("- **[", F.upper("severity"), "]** ", c("title"), " _(confidence=", c("confidence"), ", kind=", c("kind"), ")_"),
        text("  - ", c("narrative")),
        text("  - _Action:_ ", c("action")),
        text("  - _ATT&CK:_ ", c("named")),
        F.when(c("evidence") != "", text("  - _Evidence:_ ", F.array_join(F.slice(F.split("evidence", r" \| "), 1, 3), "; "))),
    ).union(more(placed, SHOWN["insights"], " more."))
    used = technique_use(overlay.insights, overlay.findings)
    ids = first_rows(used, ["repo"], ["technique"], 100).select("repo", F.col("rn").alias("place"), text("- `", c("technique"), "` **", c("name"), "** - _", c("tactic"), "_").alias("line"))
    order = placed.select("repo", c("id").alias("insight"), "place")
    ranked = first_rows(overlay.opportunities.join(order, ["repo", "insight"], "left"), ["repo"], [F.asc_nulls_last("place")], 1000).drop("place").withColumnRenamed("rn", "place")
    watch = numbered(
        ranked.where(c("place") <= SHOWN["opportunities"]),
        text("- **", c("title"), "** _(signal=", c("signal"), ")_"),
        text("  - _Why:_ ", c("rationale")),
        text("  - _Rule:_ ", c("rule")),
        F.when(c("techniques") != "", text("  - _ATT&CK:_ ", F.array_join(F.transform(F.slice(F.split("techniques", ","), 1, 4), lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", "))),
    ).union(more(ranked, SHOWN["opportunities"], " more."))
    held = first_rows(overlay.assets, ["repo"], [rank_of(c("criticality"), CRITICALITY), "kind", "id"], SHOWN["assets"])
    why = F.array_join(F.slice("evidence", 1, 3), "; ")
    inventory = held.select(
        "repo",
        F.col("rn").alias("place"),
        text("- **", c("name"), "** (", c("kind"), ", criticality=", c("criticality"), ")", F.when(why != "", text(": ", why)).otherwise("")).alias("line"),
    )
    by_strength = [rank_of(c("strength"), STRENGTHS), "kind", "name", "id"]
    present = first_rows(overlay.controls.where(there), ["repo"], by_strength, SHOWN["controls"])
    seen = present.select(
        "repo",
        F.col("rn").alias("place"),
        text("- `", c("kind"), "` ", c("name"), " (strength=", c("strength"), "), in ", F.size("placements").cast("string"), " file(s)").alias("line"),
    )
    absent = first_rows(overlay.controls.where(~there), ["repo"], by_strength, SHOWN["absent"])
    missed = absent.select("repo", (F.col("rn") + 200_000).alias("place"), text("- `", c("kind"), "` ", c("name"), ": ", c("notes")).alias("line"))
    head = lambda df, place, line: df.select("repo").distinct().select("repo", F.lit(place).alias("place"), F.lit(line).alias("line"))
    controls = seen.union(head(present, 0, "**Observed:**")).union(more(overlay.controls.where(there), SHOWN["controls"], " more.")).union(missed).union(head(absent, 200_000, "**Expected but not observed:**"))
    return document(
        scan,
        REVIEW,
        {
            1: (overview, ("",)),
            2: (observations, ("- Nothing that cuts across signals was found.",)),
            3: (ids, ("- No techniques are mapped.",)),
            4: (watch, ("- There is nothing to watch for.",)),
            5: (inventory.union(more(overlay.assets, SHOWN["assets"], " more.")), ("- No assets of high value were found.",)),
            6: (controls, ("- No controls were seen.",)),
            7: (strengths(scan, surfaces), ("",)),
            8: (weaknesses(scored, surfaces), ("- None was found.",)),
            9: (evidence_chains(paths), ("- No attack path was made of these signals.",)),
            10: (recommendations(scan, scored, paths), ("",)),
            11: (None, NOTES),
        },
    )
