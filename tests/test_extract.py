"""Extraction of long files and of odd ones: time in proportion to the matches, places and prefixes as defined."""

import time

import pytest
from pyspark.sql import functions as F

from factloom.operators import extract

SCHEMA = "repo string, file string, suffix string, content string"


def files(spark, *contents):
    return spark.createDataFrame([("r", f"f{i}{s}", s, c) for i, (s, c) in enumerate(contents)], SCHEMA)


def test_long_files_take_time_in_proportion(spark):
    took = {}
    for n in (1000, 32_000):
        source = files(spark, (".js", "".join(f'app.get("/p{i}", f)\n' for i in range(n))))
        extract.extract_routes(source).count()  # plans once
        began = time.time()
        rows = extract.extract_routes(source).where("path = concat('/p', line - 1)").count()
        took[n] = time.time() - began
        assert rows == n
    assert took[32_000] < 15 + took[1000]


def test_very_many_mounts(spark):
    n = 20_000
    source = files(spark, (".js", "".join(f'app.use("/m{i}", r{i})\nr{i}.get("/x", f)\n' for i in range(n))))
    assert extract.extract_routes(source).where("path = concat('/m', int((line - 2) / 2), '/x')").count() == n


def test_offsets_and_lines_over_several_lines(spark):
    content = 'é\n\nroot = APIRouter(\n  prefix="/v")\n@root.get(\n"/a")\n\n@root.post("/b")'
    source = files(spark, (".py", content), (".py", ""), (".py", None), (".py", "\u0001@x.get('/c')\u0002\u0003"))
    rows = sorted((r.file, r.method, r.path, r.line, r.seq.offset) for r in extract.extract_routes(source).collect())
    assert rows == [("f0.py", "GET", "/v/a", 5, content.index("@root.get")), ("f0.py", "POST", "/v/b", 8, content.index("@root.post")), ("f3.py", "GET", "/c", 1, 1)]


@pytest.mark.parametrize(("content", "paths"), [
    ('a.use("/1", b);b.use("/2", c);c.get("/x", f)', ["/1/2/x"]),
    ('a.use("/1", b);b.use("/2", a);b.get("/x", f)', ["/x"]),
    ('a.use("/1", b);z.use("/2", b);b.get("/x", f)', ["/2/x"]),
    ('a.use("/1", a);a.get("/x", f)', ["/x"]),
    ("".join(f'r{i}.use("/{i}", r{i + 1});' for i in range(40)) + 'r40.get("/x", f)', ["/" + "/".join(map(str, range(40))) + "/x"]),
])
def test_mounts_are_walked(spark, content, paths):
    assert [r.path for r in extract.extract_routes(files(spark, (".js", content))).collect()] == paths


def test_no_files(spark):
    assert extract.extract_routes(files(spark, (".js", "x")).limit(0)).collect() == []
    assert extract.prefixes(files(spark, (".js", "x"))).collect() == []


def test_every_match_holds_a_word_that_its_rule_needs(spark):
    said = {
        "a.py": 'root = APIRouter(prefix="/v")\nRoot.INCLUDE_ROUTER(child, prefix="c")\n@child.GET("/x")\nbp = Blueprint("b", n, url_prefix="p")\napp.register_blueprint(bp)\n@bp.route("/y")\n@root.api_route("/z")\n',
        "b.js": 'app.use("/m", r)\nr.route("/w")\n  .get(a)\napp.All("top")\nrequests.get("u"); axios.put("v"); fetch("w")\nOS.getenv("A_KEY") + process.env.B_KEY\n',
    }
    rules = [v for v in vars(extract).values() if isinstance(v, extract.Rule) and v.needs]
    rules += [*extract.CALLS, *extract.SECRETS, *(r for r, _ in (*extract.DATABASES, *extract.AUTH))]
    said["c.py"] = 'create_engine("MYSQL+x")\nsqlite3.Connect(\npsycopg.connect(\nMongoClient(AsyncIOMotorClient(\nredis.StrictRedis(\nnew  PrismaClient(\nmongoose.connect(\nnew Pool(\n@login_required\n@jwt_required\nDepends( verify_token )\nOAuth2PasswordBearer(\nrequest.authorization\nAuthorization"]\npassport.authenticate(\nverifyToken\nauthMiddleware\n'
    files = spark.createDataFrame(list(said.items()), "file string, content string")
    assert all(r.needs for r in rules)
    for rule in rules:
        plain = files.where(F.col("content").rlike(f"(?U{rule.flags}){rule.pattern}")).count()
        assert plain and plain == files.where(extract.may_match(F.col("content"), rule) & F.col("content").rlike(rule.java())).count(), rule


def test_letters_that_are_one_with_ascii_are_found(spark):
    files = spark.createDataFrame([("r", "a.py", ".py", "ſqlİte3.connect(\nx = APIRouter()\n@x.get('/a')")], "repo string, file string, suffix string, content string")
    assert [r.kind for r in extract.extract_databases(files).where("not by_word").collect()] == ["sqlite"]
    assert [r.path for r in extract.extract_routes(files).collect()] == ["/a"]


def test_a_long_word_is_tried_once(spark):
    files = spark.createDataFrame([("r", "a.py", ".py", "x" * 300_000 + "\ny = APIRouter(prefix='/v')\n@y.get('/a')\n")], "repo string, file string, suffix string, content string")
    begin = time.monotonic()
    assert [r.path for r in extract.extract_routes(files).collect()] == ["/v/a"]
    assert time.monotonic() - begin < 60
