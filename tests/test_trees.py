"""Directory trees as files, analyzers over them, and results put together."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from factloom import registry
from factloom.operators import extract
from factloom.operators.signals import MergeRule, merge_results
from factloom.registry import BUILT_IN, Metadata, metadata_of
from factloom.sources.trees import OPENING, TreeReader, read_tree


@pytest.fixture()
def tree(tmp_path):
    def put(path, data=""):
        file = tmp_path / "shop" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("app.py", "app = FastAPI()\r\n@app.get('/x')\r\ndef f(): pass\r\n")
    put("pkg/__init__.py", "os.getenv('API_KEY')")
    put("pkg/__tests__/a.ts", "r.use('/a', b);\nb.post('c', f)\n")
    put("web/server.js", "fetch('https://h')\n")
    put("web/bad.js", b"app.get('/never')\xff")
    put("web/view.tsx", "authMiddleware")
    for hidden in (".hidden.py", "node_modules/x/a.js", "lib/.venv/b.py", "dist/c.js", "a/build/d.py", "notes.md", "distant/e.txt"):
        put(hidden, "app.get('/hidden', f)")
    (tmp_path / "shop" / "link.py").symlink_to(tmp_path / "shop" / "app.py")
    return tmp_path


def test_trees_are_read_whole(spark, tree):
    rows = {r.file: r for r in read_tree(spark, str(tree / "shop")).collect()}
    assert set(rows) == {"app.py", "link.py", "pkg/__init__.py", "pkg/__tests__/a.ts", "web/server.js", "web/bad.js", "web/view.tsx"}
    assert {r.repo for r in rows.values()} == {"shop"} and rows["app.py"].suffix == ".py" and rows["web/bad.js"].content.endswith(b"\xff")
    some = read_tree(spark, str(tree), each=True, suffixes=(".ts", ".tsx"))
    assert sorted((r.repo, r.file) for r in some.collect()) == [("shop", "pkg/__tests__/a.ts"), ("shop", "web/view.tsx")]
    assert extract.accepted(read_tree(spark, str(tree / "shop"))).count() == len(rows)  # the same rule
    (tree / "empty").mkdir()
    assert read_tree(spark, str(tree / "empty")).count() == 0
    with pytest.raises(Exception, match="isn't a folder"):
        read_tree(spark, str(tree / "nowhere")).count()


def test_files_are_dealt_by_bytes_and_options_leave_the_others_closed(spark, tmp_path):
    deep = tmp_path / "mono" / "packages" / "all"
    deep.mkdir(parents=True)
    for i in range(10_000):
        (deep / f"f{i}.{'py' if i % 100 else 'ts'}").write_bytes(b"x" * (i % 7))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.py").write_bytes(b"y" * 100)
    reader = TreeReader({"path": str(tmp_path), "each": "true", "task_bytes": str(50 * (OPENING + 10))})
    shares = reader.partitions()
    assert 200 <= len(shares) <= 203 and max(len(s.files) for s in shares) <= 51 and sum(len(s.files) for s in shares) == 10_001
    wanted = TreeReader({"path": str(tmp_path), "each": "true", "suffixes": ".ts", "repos": '["mono", "x"]'})
    assert sorted(f for s in wanted.partitions() for _, _, f in s.files) == sorted(f"packages/all/f{i}.ts" for i in range(0, 10_000, 100))
    assert read_tree(spark, str(tmp_path), each=True, suffixes=(".ts",), repos=("mono",)).count() == 100
    assert read_tree(spark, str(tmp_path), each=True, repos=("other",)).first().content == b"y" * 100
    files = read_tree(spark, str(tmp_path), each=True)
    assert files.where("suffix = '.md'").count() == 0 and files.count() == 10_001


def test_built_in_analyzers_over_a_tree(spark, tree):
    found = registry.analyze(read_tree(spark, str(tree), each=True), BUILT_IN)
    meta = {r.repo: (r.languages, r.files_scanned) for r in found.meta.collect()}
    assert meta == {"shop": (["javascript", "python", "typescript"], 7)}  # the file that isn't UTF-8 counts
    assert sorted((r.path, r.method, r.file, r.line) for r in found.scan.route.collect()) == [("/a/c", "POST", "pkg/__tests__/a.ts", 2), ("/x", "GET", "app.py", 2), ("/x", "GET", "link.py", 2)]
    assert [r.name for r in found.scan.secret_hint.collect()] == ["API_KEY"] and [r.target for r in found.scan.external_call.collect()] == ["https://h"]
    assert sorted((r.hint, r.confidence) for r in found.scan.hint.collect()) == [("api_key", 0.5), ("auth_middleware", 0.85)]


class Named:
    def __init__(self, name, scan=None, detect=None, **more):
        self.metadata, self.scan = Metadata(name, **more), scan
        if detect is not None:
            self.detect = detect

    @property
    def name(self):
        return self.metadata.name

    def analyze(self, files):
        return BUILT_IN[0].analyze(files)


def test_detect_says_where_an_analyzer_runs(spark):
    files = spark.createDataFrame([("a", "x.py", ".py", "@r.get('/1')"), ("b", "x.py", ".py", "@r.get('/2')")], "repo string, file string, suffix string, content string")

    def fails(_):
        raise RuntimeError("no")

    run = lambda detect: sorted(r.path for r in registry.analyze(files, [Named("n", detect=detect)]).scan.route.collect())
    assert run(None) == ["/1", "/2"] == run(lambda f: True) and run(lambda f: False) == [] == run(fails)
    assert run(lambda f: f.where("repo = 'b'")) == ["/2"]
    assert sorted(r.repo for r in registry.analyze(files, []).meta.collect()) == ["a", "b"]


def test_results_are_merged_in_turn(spark):
    files = lambda line: spark.createDataFrame([("a", "x.py", ".py", "\n" * line + "@r.get('/1')")], "repo string, file string, suffix string, content string")
    results = [BUILT_IN[0].analyze(files(n)) for n in (3, 1)]
    found = merge_results(results, files(0).select("repo"))
    assert [r.line for r in found.scan.route.collect()] == [4] and found.meta.first().files_scanned == 2
    assert found.meta.first().languages == ["python"]


def test_rules_of_merging_are_identifiers():
    with pytest.raises(ValueError, match="identifiers"):
        MergeRule("route; drop", ("path",))
    with pytest.raises(ValueError, match="identifiers"):
        MergeRule("route", ("a b",))


def test_metadata_is_normalized():
    assert metadata_of({"name": "x", "ecosystems": ["Rust", "cargo"]}).languages == ("Rust", "cargo")
    assert metadata_of({"name": "x", "ecosystems": ["Rust"], "targets": ["axum"]}).languages == ()
    assert metadata_of({"name": "x"}).display_name == "x" and metadata_of({"name": "x", "display_name": "X", "odd": 1}).display_name == "X"
    assert Metadata("x", targets=("Flask", "B"), languages=("Python", "flask")).ecosystems == ("python", "flask", "b")
    own = type("Old", (), {"name": "old", "languages": ["Go"], "priority": 3})()
    assert metadata_of(own).languages == ("Go",) and metadata_of(own).priority == 3 and metadata_of(metadata_of(own)) == metadata_of(own)
    for bad in ({}, {"name": " "}, None):
        with pytest.raises((ValueError, TypeError)):
            metadata_of(bad)


class Point:
    def __init__(self, name, loaded):
        self.name, self.loaded = name, loaded

    def load(self):
        if isinstance(self.loaded, Exception):
            raise self.loaded
        return self.loaded


def test_plug_ins_are_discovered_in_order(caplog):
    class Own(Named):
        def __init__(self):
            super().__init__("own")

    class Fails:
        def __init__(self):
            raise RuntimeError("no")

    points = [Point("z", Own), Point("b", lambda: Named("made")), Point("a", ImportError("gone")), Point("c", Fails), Point("d", Named("python-web")), Point("e", type("X", (), {"metadata": {"name": "x"}, "name": "x"})), Point("f", type("Y", (), {"metadata": {}, "name": "y", "analyze": print}))]
    with caplog.at_level(logging.WARNING):
        assert [a.name for a in registry.discovered(points)] == ["made", "python-web", "own"]
        assert [a.name for a in registry.registered(points)] == ["python-web", "javascript-web", "default", "made", "own"]
    assert "gone" in caplog.text and "named python-web already" in caplog.text


def test_analyzers_are_selected_by_any_of_their_names():
    names = lambda *asked, **more: [a.name for a in registry.selected(asked, **more)]
    assert names(" Default ", "https://host/org/factloom-analyzer-python-web.git", "default", "org/javascript-web") == ["default", "python-web", "javascript-web"]
    assert names() == names(" ") == []
    with pytest.raises(ValueError, match="rust, go"):
        names("rust", "default", "factloom-analyzer-go")
    with pytest.raises(ValueError, match="rust couldn't be installed: factloom-analyzer-rust isn't installed"):
        names("rust", auto_install=True)
    there = []
    assert names("rust", "default", auto_install=True, installer=lambda p: there.append(Point(p, Named("rust"))), candidates=lambda: there) == ["rust", "default"]
    assert [p.name for p in there] == ["factloom-analyzer-rust"]


def test_listings(spark):
    rows = registry.listing(spark).collect()
    assert [r.name for r in rows][:3] == ["python-web", "javascript-web", "default"] and rows[0].ecosystems == ["python", "fastapi", "flask"] and not rows[0].experimental
    payload = [{"name": "factloom-analyzer-zig", "html_url": "u"}, {"name": "other"}, 7, {"name": "factloom-analyzer-ada"}]
    want = [{"name": "ada", "package": "factloom-analyzer-ada", "link": ""}, {"name": "zig", "package": "factloom-analyzer-zig", "link": "u"}]
    assert registry.remote(payload) == want == registry.remote(json.dumps(payload))
    for bad in ("{", "{}"):
        with pytest.raises(ValueError, match="listing"):
            registry.remote(bad)


def test_every_pattern_over_odd_texts(spark):
    """Marks within texts, empty and null contents, and characters that mark matches."""
    rows = [("r", "a.py", ".py", "\u0001\u0002\u0003@r.get('/\u0002x')\u0003\n\u0001"), ("r", "b.py", ".py", ""), ("r", "c.py", ".py", None), ("r", "d.md", ".md", "@r.get('/x')"), ("r", "e.js", ".js", "x.get('/é日') ; x.get('/2')")]
    files = spark.createDataFrame(rows, "repo string, file string, suffix string, content string")
    got = sorted((r.file, r.path, r.line) for r in extract.extract_routes(files).collect())
    assert got == [("a.py", "/\u0004x", 1), ("e.js", "/2", 1), ("e.js", "/é日", 1)]
    assert extract.facts(files.where("content is not null")).where(F.size("routes") > 0).count() == 2
