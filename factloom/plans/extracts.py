"""Registered queries of the extraction: source files made from the documents, and oracles that apply the patterns anew.

Each document becomes a file: a template by the remainder of its id, then its whole text. The oracles cut the same texts by
the same patterns, walk the mounts by a recursive relation, and count lines from the pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import expressions
from factloom.operators import extract
from factloom.operators.extract import Rule
from factloom.plans.oracles import any_of, q

TEMPLATES = (
    (
        ".py",
        'root = APIRouter(\n  tags=["x"], prefix="/v<k>")\nchild = APIRouter()\nroot.include_router(child,'
        ' prefix="c/")\n@child.get("/items")\ndef f(): pass\n@root.api_route("x//y", methods=["GET",'
        ' "post"])\n@root.api_route("/all")\nkey = os.getenv("API_TOKEN")\nrequests.get("https://h<k>/a")\n@lone.Delete( "gone" )\n',
    ),
    (
        ".js",
        'const app = e();\napp.use("/m<k>", r);\nr.all("/z", h);\nr.route("/w")\n  .get(a)\n  .post(b)\napp.get("top",'
        ' process.env.APP_KEY)\nfetch("https://f<k>"); axios.post("https://g")\nnew Pool(1)\n',
    ),
    (
        ".py",
        'bp = Blueprint("b", __name__, url_prefix="b<k>")\nsub = Blueprint("s", __name__)\napp.register_blueprint(bp,'
        ' url_prefix="/api")\nbp.register_blueprint(sub)\n@bp.route("/x")\n@sub.route("/y", methods=["PUT",'
        ' "ALL"])\n@login_required\ndef f(): sqlite3.connect("a")\n',
    ),
    (".ts", "".join(f'r{i}.use("/p{i}", r{i + 1});\n' for i in range(20)) + 'r20.get("/deep", f)\na.use("/a", b);\nb.use("/b", a);\nb.put("/ring", g)\nr3.route("/chain").all(a)\n'),
    (
        ".py",
        'create_engine("postgresql+driver")\npsycopg2.connect("")\nMongoClient("")\nredis.Redis()\n@jwt_required\nDepends( get_current_user )\nOAuth2PasswordBearer("")\nrequest.authorization\nheaders["Authorization"]\n  ' + "long " * 40 + ' os.getenv("DB_PASSWORD")\n',
    ),
    (".tsx", 'new  PrismaClient()\nmongoose.connect("")\nnew Pool()\npassport.authenticate("x")\nverifyToken()\nauthMiddleware\nprocess.env.aSecret_1 + process.env.OTHER\n'),
    (".js", "// mysql, redis and sqlite; bearer, apikey, mfa and Auth0 by name only\nx.use('no double quotes', y)\n"),
    (".md", 'app.get("/never", f)\nos.getenv("DOC_KEY")\n'),
)
FOLDERS = ("", "src/", "node_modules/x/", "lib/.venv/", "distant/", "build/", "Dist/")


def case(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


SUFFIX = case("doc_id", tuple(f"'{s}'" for s, _ in TEMPLATES))
FILE = f"concat({case('(doc_id * 5)', tuple(q(f) for f in FOLDERS))}, CASE WHEN doc_id % 13 = 0 THEN '.' ELSE '' END, 'f', doc_id, {SUFFIX})"


def made(text: Callable[[str], str]) -> str:
    """The files as SQL; text writes a literal."""
    content = case("doc_id", tuple(text(t) for _, t in TEMPLATES))
    return (
        f"SELECT concat('r', doc_id % 20) AS repo, {FILE} AS file, {SUFFIX} AS suffix, concat(replace({content}, '<k>', CAST(doc_id % 3 AS STRING)), '# ',"
        f" coalesce(text, '')) AS content, doc_id FROM "
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, file, suffix, content (and doc_id) of a file for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    literal = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql(made(literal) + "{docs}", docs=docs)


def accepted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.accepted(source_files(spark, sf_dir))


SKIPPED = " OR ".join(f"list_contains(string_split(file, '/'), '{x}')" for x in extract.SKIPPED)
SOURCE = (
    f"source_file AS MATERIALIZED ({made(q)} documents WHERE doc_id IS NOT NULL), kept AS MATERIALIZED (SELECT * FROM source_file"
    f" WHERE NOT starts_with(string_split(file, '/')[-1], '.') AND NOT ({SKIPPED}) AND suffix IN ('.py', '.js', '.ts', '.tsx'))"
)


def found(rule: Rule, where: str, pattern: str | None = None) -> str:
    """repo, file, i, g1.., whole, pre (the text before a match), line, content: the matches of a pattern, numbered."""
    p = q(pattern or rule.plain())
    groups = ", ".join(f"regexp_extract_all(content, {p}, {g}) AS a{g}" for g in range(1, rule.groups + 1))
    taken = ", ".join(f"a{g}[i] AS g{g}" for g in range(1, rule.groups + 1))
    return (
        f"SELECT repo, file, content, i, {taken}, whole[i] AS whole, pre, 1 + length(pre) - length(replace(pre, '\n', '')) AS line FROM (SELECT *,"
        f" array_to_string(pieces[:i], '') || array_to_string(whole[:i - 1], '') AS pre "
        f"FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT repo, file, content, string_split_regex(content, {p}) AS pieces,"
        f" regexp_extract_all(content, {p}, 0) AS whole, {groups} FROM kept WHERE {where})))"
    )


def normal(x: str) -> str:
    return f"regexp_replace('/' || trim(coalesce({x}, ''), ' \t\n\r'), '/+', '/', 'g')"


def joined(a: str, b: str) -> str:
    return f"(SELECT CASE WHEN x = '/' THEN y WHEN y = '/' THEN x ELSE rtrim(x, '/') || '/' || ltrim(y, '/') END FROM (SELECT {normal(a)} AS x, {normal(b)} AS y))"


PY, JS = "suffix = '.py'", "suffix IN ('.js', '.ts', '.tsx')"
#: A chain goes on in lines that begin with a dot; the files have no other lines that go on.
CHAIN = r"""(?i)\b(\w+)\.route\(\s*['"]([^'"]+)['"]\s*\)([^\n]*(?:\n\s*\.[^\n]*)*)"""
ROUTING = f"""local AS MATERIALIZED (SELECT repo, file, g1 AS router, arg_max(g2, (o, i)) AS prefix FROM (SELECT 0 AS o, * FROM ({found(extract.ROUTER, PY)}) UNION ALL SELECT 1, * FROM ({found(extract.BLUEPRINT, PY)})) GROUP BY ALL),
mount AS MATERIALIZED (SELECT repo, file, router, arg_max(parent, (o, i)) AS parent, arg_max(extra, (o, i)) AS extra FROM (
  SELECT repo, file, 0 AS o, i, g1 AS parent, g2 AS router, g3 AS extra FROM ({found(extract.INCLUDE, PY)}) UNION ALL SELECT repo, file, 1, i, g1, g2, g3 FROM ({found(extract.REGISTER, PY)})
  UNION ALL SELECT repo, file, 2, i, g1, g3, g2 FROM ({found(extract.USE, JS)})) GROUP BY repo, file, router),
step AS MATERIALIZED (SELECT m.repo, m.file, m.router, m.parent, {joined("m.extra", "l.prefix")} AS path FROM mount m LEFT JOIN local l USING (repo, file, router)),
walk(repo, file, router, top, path, n) AS (SELECT repo, file, router, parent, path, 1 FROM step UNION ALL SELECT w.repo, w.file, w.router, s.parent, {joined("s.path", "w.path")}, n + 1 FROM walk w JOIN step s ON s.repo = w.repo AND s.file = w.file AND s.router = w.top WHERE n < 60),
mounted AS (SELECT w.repo, w.file, w.router, {joined("l.prefix", "w.path")} AS prefix FROM walk w LEFT JOIN local l ON l.repo = w.repo AND l.file = w.file AND l.router = w.top WHERE NOT EXISTS (SELECT 1 FROM mount m WHERE m.repo = w.repo AND m.file = w.file AND m.router = w.top)),
prefix AS MATERIALIZED (SELECT * FROM mounted UNION ALL SELECT repo, file, router, coalesce(l.prefix, '') FROM (SELECT repo, file, router FROM local UNION SELECT repo, file, router FROM mount) r LEFT JOIN local l USING (repo, file, router) WHERE NOT EXISTS (SELECT 1 FROM mounted m WHERE m.repo = r.repo AND m.file = r.file AND m.router = r.router)),
"""
ANY = "CASE WHEN upper({0}) = 'ALL' THEN 'ANY' ELSE upper({0}) END"


def listed(rule: Rule, default: str, o: int) -> str:
    verbs = f"regexp_extract_all(g3, {q(extract.METHOD.plain())}, 1)"
    own = f"CASE WHEN len({verbs}) = 0 THEN ['{default}'] ELSE list_transform({verbs}, lambda x: {ANY.format('x')}) END"
    return f"SELECT repo, file, g1 AS router, g2 AS raw, unnest({own}) AS method, line, {o} AS o FROM ({found(rule, PY)})"


VERB = q(extract.CHAIN_VERB.plain())
CHAINED = f"""SELECT repo, file, g1 AS router, g2 AS raw, {ANY.format("v[j]")} AS method, 1 + length(before) - length(replace(before, '\n', '')) AS line, 4 AS o
  FROM (SELECT *, pre || left(whole, length(whole) - length(g3)) || array_to_string(cuts[:j], '') || array_to_string(dots[:j - 1], '') AS before FROM (SELECT *, unnest(range(1, len(v) + 1)) AS j
  FROM (SELECT *, regexp_extract_all(g3, {VERB}, 1) AS v, string_split_regex(g3, {VERB}) AS cuts, regexp_extract_all(g3, {VERB}, 0) AS dots FROM ({found(extract.CHAIN, JS, CHAIN)}))))"""
ROUTES = f"""routes AS (SELECT r.*, {joined("p.prefix", "r.raw")} AS path FROM (
  SELECT repo, file, g1 AS router, g3 AS raw, upper(g2) AS method, line, 0 AS o FROM ({found(extract.DECORATOR, PY)}) UNION ALL {listed(extract.API_ROUTE, "ANY", 1)} UNION ALL {listed(extract.FLASK_ROUTE, "GET", 2)}
  UNION ALL SELECT repo, file, g1, g3, {ANY.format("g2")}, line, 3 FROM ({found(extract.DIRECT, JS)}) UNION ALL {CHAINED}) r LEFT JOIN prefix p USING (repo, file, router))
"""
WITH_ROUTES = f"WITH RECURSIVE {SOURCE}, {ROUTING}{ROUTES}"


LINE_TEXT = "regexp_replace(string_split(content, '\n')[line], '^\\s+|\\s+$', '', 'g')"
SNIPPET = f"CASE WHEN length({LINE_TEXT}) > 160 THEN left({LINE_TEXT}, 159) || '…' ELSE {LINE_TEXT} END"


def values(rules: tuple[Rule, ...]) -> str:
    return " UNION ALL ".join(f"SELECT repo, g1 AS value, file, line, {SNIPPET} AS evidence, {o} AS o FROM ({found(r, 'true')})" for o, r in enumerate(rules))


def marks(rules: tuple[tuple[Rule, str], ...], words: tuple[tuple[str, str], ...]) -> str:
    """repo, file, label, line, by_word: the first place of each rule, and of a label the first rule."""
    before = lambda p: f"string_split_regex(content, {q(p)})[1]"
    by_rule = [f"SELECT repo, file, {q(label)} AS label, {before(r.plain())} AS pre, {o} AS o FROM kept WHERE regexp_matches(content, {q(r.plain())})" for o, (r, label) in enumerate(rules)]
    by_word = [f"SELECT repo, file, {q(label)}, left(content, strpos(lower(content), {q(w)}) - 1), {100 + o} FROM kept WHERE {any_of('lower(content)', (w,))}" for o, (w, label) in enumerate(words)]
    rows = " UNION ALL ".join(by_rule + by_word)
    return (
        f"SELECT repo, file, label, 1 + length(pre) - length(replace(pre, '\n', '')) AS line, o >= 100 AS by_word FROM (SELECT *,"
        f" row_number() OVER (PARTITION BY repo, file, label ORDER BY o) AS rn FROM ({rows})) WHERE rn = 1"
    )


RULES_OF_ROUTES = {"ext_fastapi_decorator": 0, "ext_fastapi_api_route": 1, "ext_flask_route": 2, "ext_express_direct": 3, "ext_express_chain": 4}
AUTH_WORDS = tuple((w, w) for w in extract.AUTH_WORDS)
LANGUAGE = "CASE suffix WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' ELSE 'typescript' END"


def binary(files: DataFrame) -> DataFrame:
    """The files as bytes: every fifth isn't UTF-8, every third has other line ends."""
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("content", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("content"))
    data = F.concat(F.encode(text, "UTF-8"), F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    return files.withColumn("content", data)


def register(queries: dict, oracles: dict) -> None:
    def add(name: str, build: Callable[[DataFrame], DataFrame], sql: str, files: Callable = accepted_files) -> None:
        queries[name] = lambda spark, sf_dir: build(files(spark, sf_dir))
        oracles[name] = sql

    plain = f"WITH {SOURCE} "
    add("src_prune", lambda f: f.select("repo", "file", "suffix"), plain + "SELECT repo, file, suffix FROM kept")
    add("src_suffix_filter", lambda f: extract.accepted(f, (".ts", ".tsx")).select("repo", "file"), plain + "SELECT repo, file FROM kept WHERE suffix IN ('.ts', '.tsx')", source_files)
    size = lambda f: extract.decoded(binary(f)).select("repo", "file", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))
    add(
        "src_decode_utf8",
        size,
        plain + (
            "SELECT repo, file, CASE WHEN doc_id % 5 > 0 THEN length(t) END::INTEGER AS n_chars, CASE WHEN doc_id % 5 > 0 THEN md5(t) END AS digest FROM (SELECT *,"
            " regexp_replace(content, '\r\n?', '\n', 'g') AS t FROM kept)"
        ),
    )
    by_repo = f"SELECT repo, array_to_string(list_sort(list(DISTINCT {LANGUAGE})), ', ') AS languages, count(*) AS files_scanned FROM kept GROUP BY repo"
    add("src_language_tag", lambda f: extract.scanned(f).select("repo", F.array_join("languages", ", ").alias("languages"), "files_scanned"), plain + by_repo)
    add("src_files_scanned", lambda f: extract.scanned(f).select("repo", "files_scanned"), plain + "SELECT repo, count(*) AS files_scanned FROM kept GROUP BY repo")
    add("ext_routes", lambda f: extract.extract_routes(f).drop("seq"), WITH_ROUTES + "SELECT repo, path, method, file, line FROM routes")
    for name, o in RULES_OF_ROUTES.items():
        add(name, lambda f, k=o: extract.extract_routes(f).where(F.col("seq.o") == k).drop("seq"), WITH_ROUTES + f"SELECT repo, path, method, file, line FROM routes WHERE o = {o}")
    add("ext_prefix_fixpoint", extract.prefixes, WITH_ROUTES + "SELECT repo, file, router, prefix FROM prefix")
    add("ext_external_calls", lambda f: extract.extract_calls(f), plain + f"SELECT repo, value AS target, file, line, evidence FROM ({values(extract.CALLS)})")
    secrets = f"({values(extract.SECRETS)})"
    add("ext_secrets", lambda f: extract.extract_secrets(f).drop("evidence"), plain + f"SELECT repo, value AS name, file, line FROM {secrets}")
    add("ext_line_snippet", lambda f: extract.extract_secrets(f).select("file", "line", "evidence"), plain + f"SELECT file, line, evidence FROM {secrets}")
    stores, auth = marks(extract.DATABASES, extract.DATABASE_WORDS), marks(extract.AUTH, AUTH_WORDS)
    for name, word in (("ext_db_patterns", False), ("ext_db_keywords", True)):
        add(name, lambda f, w=word: extract.extract_databases(f).where(F.col("by_word") == w).drop("by_word"), plain + f"SELECT repo, label AS kind, file, line FROM ({stores}) WHERE by_word = {word}")
    for name, word in (("ext_auth_patterns", False), ("ext_auth_keywords", True)):
        sure = extract.UNSURE if word else extract.SURE
        add(
            name,
            lambda f, s=sure: extract.extract_auth(f).where(F.col("confidence") == s),
            plain + f"SELECT repo, label AS hint, file, line, {sure}::DOUBLE AS confidence FROM ({auth}) WHERE by_word = {word}",
        )
    # The patterns one by one: what each makes of its groups, where each match is, and what becomes of verbs and paths.
    for name, rule, columns, where in (
        ("ext_fastapi_router_prefix", extract.ROUTER, ("router", "prefix"), PY),
        ("ext_flask_blueprint_prefix", extract.BLUEPRINT, ("router", "prefix"), PY),
        ("ext_fastapi_include_router", extract.INCLUDE, ("parent", "router", "extra"), PY),
        ("ext_flask_register_blueprint", extract.REGISTER, ("parent", "router", "extra"), PY),
        ("ext_express_use_prefix", extract.USE, ("parent", "extra", "router"), JS),
    ):
        named = ", ".join(f"coalesce(g{i + 1}, '') AS {c}" for i, c in enumerate(columns))
        add(
            name,
            lambda f, r=rule, w=where, c=columns: extract.said(f.where(w), extract.matches(F.col("content"), r)).select("repo", "file", "line", *(F.col(f"g{i + 1}").alias(x) for i, x in enumerate(c))),
            plain + f"SELECT repo, file, line, {named} FROM ({found(rule, where)})",
        )
    direct = lambda f: extract.said(f.where(JS), extract.matches(F.col("content"), extract.DIRECT))
    add("ext_line_of", lambda f: direct(f).select("repo", "file", "offset", "line"), plain + f"SELECT repo, file, length(pre)::INTEGER AS offset, line FROM ({found(extract.DIRECT, JS)})")
    verbs = f"regexp_extract_all(g3, {q(extract.METHOD.plain())}, 1)"
    add(
        "ext_method_list",
        lambda f: extract.said(f.where(PY), extract.matches(F.col("content"), extract.API_ROUTE)).select("repo", "file", "line", F.array_join(extract.methods(F.col("g3"), "ANY"), ",").alias("methods")),
        plain + (
            f"SELECT repo, file, line, CASE WHEN len({verbs}) = 0 THEN 'ANY' ELSE array_to_string(list_transform({verbs}, lambda x: {ANY.format('x')}), ',') END"
            f" AS methods FROM ({found(extract.API_ROUTE, PY)})"
        ),
    )
    add(
        "ext_normalize_path",
        lambda f: direct(f).select("repo", "file", "line", expressions.normalize_path(F.concat(F.lit("  "), "g3", F.lit("//x/ "))).alias("path")),
        plain + f"SELECT repo, file, line, {normal(chr(39) + '  ' + chr(39) + ' || g3 || ' + q('//x/ '))} AS path FROM ({found(extract.DIRECT, JS)})",
    )
    add(
        "ext_join_route_parts",
        lambda f: direct(f).select("repo", "file", "line", expressions.join_route_parts(F.col("g1"), F.col("g3")).alias("path")),
        plain + f"SELECT repo, file, line, {joined('g1', 'g3')} AS path FROM ({found(extract.DIRECT, JS)})",
    )
    add(
        "ext_route_dispatch",
        lambda f: extract.extract_routes(f).groupBy(F.substring_index("file", ".", -1).alias("kind"), F.when(F.col("seq.o") < 3, "python").otherwise("script").alias("family")).agg(F.count("*").alias("n")),
        WITH_ROUTES + "SELECT string_split(file, '.')[-1] AS kind, CASE WHEN o < 3 THEN 'python' ELSE 'script' END AS family, count(*) AS n FROM routes GROUP BY ALL",
    )
