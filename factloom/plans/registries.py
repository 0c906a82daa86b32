"""Registered queries of merging results and of the analyzers, with their oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import registry
from factloom.operators import extract, signals
from factloom.operators.overlay import union
from factloom.operators.signals import MERGE, Result
from factloom.plans.extracts import AUTH_WORDS, LANGUAGE, SNIPPET, SOURCE, WITH_ROUTES, accepted_files, marks, source_files, values
from factloom.plans.oracles import q
from factloom.sources.adapters import Scan

TURNS = 3


def thirds(scan: Scan) -> list[Scan]:
    """The scan as three analyzers might have found it: by the remainder of seq."""
    part = lambda i: {r.attr: getattr(scan, r.attr).where(F.col("seq") % TURNS == i) for r in MERGE}
    return [replace(scan, **part(i)) for i in range(TURNS)]


def results(scan: Scan) -> list[Result]:
    """Those scans with languages and files of their own: each third's route files, python for the second, and javascript."""
    own = ([], ["python"], ["javascript", "python"])
    out = []
    for s, languages in zip(thirds(scan), own, strict=True):
        listed = F.array(*map(F.lit, languages)).cast("array<string>")
        out.append(Result(s, s.route.groupBy("repo").agg(F.count_distinct("file").alias("files_scanned")).withColumn("languages", listed)))
    return out


def counted(scan: Scan) -> DataFrame:
    """repo, relation, n, lines (their sum) of each family."""
    rows = [getattr(scan, r.attr).groupBy("repo").agg(F.count("*").alias("n"), F.sum(F.coalesce("line", F.lit(0))).cast("long").alias("lines")).withColumn("relation", F.lit(r.attr)) for r in MERGE]
    return union(rows)


def merged_sql(once: tuple[str, ...]) -> str:
    """The same in SQL; the families in once are deduplicated."""
    parts = []
    for r in MERGE:
        source = r.attr
        if r.attr in once:
            source = f"(SELECT *, row_number() OVER (PARTITION BY repo, {', '.join(r.keys)} ORDER BY seq % {TURNS}, seq) AS rn FROM {r.attr}) WHERE rn = 1"
        parts.append(f"SELECT repo, '{r.attr}' AS relation, count(*) AS n, sum(coalesce(line, 0))::BIGINT AS lines FROM {source} GROUP BY repo")
    return " UNION ALL ".join(parts)


def register(add: Callable, queries: dict, oracles: dict) -> None:
    every = tuple(r.attr for r in MERGE)

    def merged_with_meta(a) -> DataFrame:
        found = signals.merge_results(results(a.scan), a.scan.repo)
        meta = found.meta.select("repo", F.array_join("languages", ", ").alias("languages"), "files_scanned")
        return meta.join(counted(found.scan), "repo", "left")

    meta = f"""SELECT p.repo, coalesce(array_to_string(list_sort(list_distinct(flatten([CASE WHEN b THEN ['python'] ELSE [] END, CASE WHEN c THEN ['javascript', 'python'] ELSE [] END]))), ', '), '') AS languages, coalesce(files_scanned, 0) AS files_scanned
      FROM repo p LEFT JOIN (SELECT repo, bool_or(t = 1) AS b, bool_or(t = 2) AS c, sum(n)::BIGINT AS files_scanned FROM (SELECT repo, seq % {TURNS} AS t, count(DISTINCT file) AS n FROM route GROUP BY ALL) GROUP BY repo) x USING (repo)"""
    add("mrg_results", merged_with_meta, f"SELECT m.*, k.* EXCLUDE (repo) FROM ({meta}) m LEFT JOIN ({merged_sql(every)}) k USING (repo)")
    add("mrg_file_signals", lambda a: counted(signals.file_signals(thirds(a.scan))), merged_sql(("database_hint", "hint")))

    def put(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
        queries[name], oracles[name] = build, sql

    def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = source_files(spark, sf_dir)
        return union([extract.accepted(files, a.suffixes).select("repo", "file", F.lit(a.name).alias("analyzer")) for a in registry.BUILT_IN])

    analyzer = "CASE suffix WHEN '.py' THEN 'python-web' WHEN '.js' THEN 'javascript-web' ELSE 'default' END"
    put("src_builtin_analyzers", dealt, f"WITH {SOURCE} SELECT repo, file, {analyzer} AS analyzer FROM kept")

    def families(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = accepted_files(spark, sf_dir)
        return union([f(files).groupBy("repo").agg(F.count("*").alias("n")).withColumn("family", F.lit(k)) for k, f in registry.FILE_ANALYZERS.items()])

    stores, auth = marks(extract.DATABASES, extract.DATABASE_WORDS), marks(extract.AUTH, AUTH_WORDS)
    relations = {"routes": "routes", "external_calls": f"({values(extract.CALLS)})", "databases": f"({stores})", "auth": f"({auth})", "secrets": f"({values(extract.SECRETS)})"}
    put("src_file_analyzers", families, WITH_ROUTES + " UNION ALL ".join(f"SELECT repo, '{k}' AS family, count(*) AS n FROM {t} GROUP BY repo" for k, t in relations.items()))

    def with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All merged signals of the files, with the lines that say so."""
        scan = registry.analyze(source_files(spark, sf_dir), registry.BUILT_IN).scan
        return signals.all_signals(scan).where("kind <> 'route'").select("repo", "kind", "label", "file", "line", "confidence", "evidence")

    once = lambda kind, rules, sure: (
        f"SELECT repo, '{kind}' AS kind, value AS label, file, line, {sure}::DOUBLE AS confidence, evidence FROM (SELECT *, row_number() OVER"
        f" (PARTITION BY repo, value, file ORDER BY o, line) AS rn FROM ({values(rules)})) WHERE rn = 1"
    )
    each = lambda kind, of, sure: f"SELECT repo, '{kind}', label, file, line, {sure}::DOUBLE, {SNIPPET} FROM ({of}) JOIN kept USING (repo, file)"
    evidence = [once("external_call", extract.CALLS, 0.7), once("secret", extract.SECRETS, extract.SECRET_SURE), each("database", stores, 0.7)]
    evidence.append(each("auth", auth, f"(CASE WHEN by_word THEN {extract.UNSURE} ELSE {extract.SURE} END)"))
    put("mrg_evidence", with_evidence, f"WITH {SOURCE} " + " UNION ALL ".join(evidence))

    def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = registry.analyze(source_files(spark, sf_dir), registry.BUILT_IN)
        scan = found.scan
        out = found.meta.select("repo", F.array_join("languages", ", ").alias("languages"), "files_scanned")
        for name, df in (("n_routes", scan.route), ("n_calls", scan.external_call), ("n_databases", scan.database_hint), ("n_hints", scan.hint), ("n_secrets", scan.secret_hint)):
            out = out.join(df.groupBy("repo").agg(F.count("*").alias(name)), "repo", "left")
        return out.na.fill(0)

    distinct = {
        "n_routes": ("routes", "path, method, file"),
        "n_calls": (f"({values(extract.CALLS)})", "value, file"),
        "n_databases": (f"({stores})", "label, file"),
        "n_hints": (f"({auth})", "label, file"),
        "n_secrets": (f"({values(extract.SECRETS)})", "value, file"),
    }
    counts = " ".join(f"LEFT JOIN (SELECT repo, count(*) AS {n} FROM (SELECT DISTINCT repo, {keys} FROM {t}) GROUP BY repo) USING (repo)" for n, (t, keys) in distinct.items())
    put(
        "mrg_analyze_repository",
        whole,
        WITH_ROUTES + f"SELECT repo, coalesce(languages, '') AS languages, coalesce(files_scanned, 0) AS files_scanned, {', '.join(f'coalesce({n}, 0) AS {n}' for n in distinct)} FROM (SELECT DISTINCT repo FROM source_file) "
        f"LEFT JOIN (SELECT repo, array_to_string(list_sort(list(DISTINCT {LANGUAGE})), ', ') AS languages, count(*) AS files_scanned FROM kept GROUP BY repo) USING (repo) {counts}",
    )
    rows = ", ".join(f"({i}, {q(a.name)}, {q(', '.join(a.metadata.ecosystems))}, {a.metadata.priority})" for i, a in enumerate(registry.BUILT_IN, 1))

    def on_files(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The analyzers, with how many files each runs on."""
        files = accepted_files(spark, sf_dir)
        n = [registry.runs_on(a, files).agg(F.count("*").alias("n_files")).withColumn("name", F.lit(a.name)) for a in registry.BUILT_IN]
        return registry.listing(spark, registry.BUILT_IN).select("place", "name", F.array_join("ecosystems", ", ").alias("ecosystems"), "priority").join(union(n), "name")

    put("src_module_listing", on_files, f"WITH {SOURCE} SELECT t.*, n_files FROM (VALUES {rows}) t(place, name, ecosystems, priority), (SELECT count(*) AS n_files FROM kept)")

    class Wanted:
        """An analyzer that runs where there are scripts."""

        name = "wanted"

        def detect(self, files: DataFrame) -> DataFrame:
            return files.where("suffix IN ('.ts', '.tsx')").select("repo")

    put(
        "src_detect_gate",
        lambda spark, sf_dir: registry.runs_on(Wanted(), accepted_files(spark, sf_dir)).select("repo", "file"),
        f"WITH {SOURCE} SELECT repo, file FROM kept WHERE repo IN (SELECT repo FROM kept WHERE suffix IN ('.ts', '.tsx'))",
    )
