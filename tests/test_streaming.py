"""Files as a stream: facts are appended, the last version of a file counts, and numbering holds for hot repositories."""

from pyspark.sql import functions as F

from factloom.operators import extract, surfaces
from factloom.sources.staged import forget, numbered, settled
from factloom.streaming import facts

FILES = "repo string, file string, suffix string, content binary, arrived long"


def test_streamed_files_make_the_scan_of_their_last_versions(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = [("r", "a.py", ".py", b"@x.get('/old')", 1), ("r", "b.js", ".js", b"x.get('/b')\r\nfetch('https://h')", 1), ("r", "c.py", ".py", b"\xff", 1), ("r", "d.md", ".md", b"x.get('/no')", 1)]
    spark.createDataFrame(first, FILES).write.mode("append").parquet(source)
    facts.append(facts.arriving(spark, source), out, state).awaitTermination()
    second = [("r", "a.py", ".py", b"@x.get('/new')\n@x.post('/more')", 2), ("s", "e.py", ".py", b"os.getenv('API_KEY')", 2)]
    spark.createDataFrame(second, FILES).write.mode("append").parquet(source)
    facts.append(facts.arriving(spark, source), out, state).awaitTermination()
    scan = facts.current(spark.read.parquet(out))
    want = extract.scan_files(spark.createDataFrame([(*r[:3], r[3].decode().replace("\r\n", "\n")) for r in (first[1], *second)], "repo string, file string, suffix string, content string"))
    for name in ("route", "external_call", "hint", "secret_hint"):
        rows = lambda s: sorted(map(str, getattr(s, name).drop("seq").collect()))  # noqa: B023, E731
        assert rows(scan) == rows(want) and rows(scan)
    assert sorted((x.route, x.method) for x in surfaces.identify_attack_surfaces(scan).collect()) == [("/b", "GET"), ("/more", "POST"), ("/new", "GET")]


def test_places_within_hot_repositories(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 7)).alias("repo"), (F.col("id") * 7919 % 2003).alias("seq"))
    got = numbered(rows, "seq", "n").collect()
    for repo in {r.repo for r in got}:
        own = sorted((r.seq, r.n) for r in got if r.repo == repo)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_what_was_written_can_be_forgotten(spark):
    kept = settled(spark.range(5), "some")
    assert kept.count() == 5
    forget(spark)
    spark.catalog.clearCache()
    assert settled(spark.range(3), "other").count() == 3
