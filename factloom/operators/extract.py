"""Extraction: routes, calls, datastores, auth marks and secrets from source files by regular expressions, in Spark alone.

``source_file`` rows are (repo, file, suffix, content). Each file is one row until its facts are known: a pattern's
matches are marked in the text by one replacement, the marked text is cut, and sums over the pieces, by doubling, give the
offset and line of each match. Prefixes of routers are found among the matches of the file, names being looked up by
sorting them with the names they are looked for in. So all that a file says is one projection, without a join or shuffle
and without Python on the executors; its time grows as the number of matches and its logarithm, and only facts are exploded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.expressions import has_any, join_normal, join_route_parts, let
from factloom.sources.adapters import Scan
from factloom.sources.staged import settled

# Suffixes with their languages, folders that aren't scanned.
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript"}
SKIPPED = ("node_modules", ".git", ".venv", "dist", "build")
VERBS = "get|post|put|delete|patch|options|head"
SCRIPTS = (".js", ".ts", ".tsx")
#: Characters that mark matches; texts that hold them have another control character there.
MARK, FIELD, END = "\u0001", "\u0002", "\u0003"
SNIPPET = 160


@dataclass(frozen=True)
class Rule:
    """A pattern, its flags (i: any case, s: dots match line ends), how many groups it has, and words (in lower case with flag
    i) of which every match holds one: texts without them aren't searched."""

    pattern: str
    flags: str = ""
    groups: int = 1
    needs: tuple[str, ...] = ()

    def java(self) -> str:
        """The pattern for Spark; classes are those of Unicode. A word in front is taken as a whole: the first match never
        begins within a word, and what follows the word isn't of it, so each word is tried once, not from each letter."""
        whole = self.pattern
        if whole.startswith(r"(\w+)"):
            whole = r"(?<!\w)(\w++)" + whole.removeprefix(r"(\w+)")
        elif whole.startswith(r"\b(\w+)\."):
            whole = r"\b(\w++)" + whole.removeprefix(r"\b(\w+)")
        return f"(?U{self.flags}){whole}"

    def plain(self) -> str:
        """The pattern for engines without that flag."""
        return f"(?{self.flags}){self.pattern}" if self.flags else self.pattern


# The patterns of each framework; group 1 is the router, then come verb, path, prefix or arguments.
ROUTER = Rule(r"""(\w+)\s*=\s*APIRouter\(\s*(?:[^)]*?\bprefix\s*=\s*['"]([^'"]*)['"])?""", "is", 2, ("apirouter(",))
BLUEPRINT = Rule(r"""(\w+)\s*=\s*Blueprint\(\s*['"][^'"]+['"]\s*,\s*[^,]+(?:,\s*url_prefix\s*=\s*['"]([^'"]*)['"])?""", "is", 2, ("blueprint(",))
INCLUDE = Rule(r"""(\w+)\.include_router\(\s*(\w+)(?:\s*,\s*prefix\s*=\s*['"]([^'"]*)['"])?""", "i", 3, (".include_router(",))
REGISTER = Rule(r"""(\w+)\.register_blueprint\(\s*(\w+)(?:\s*,\s*url_prefix\s*=\s*['"]([^'"]*)['"])?""", "i", 3, (".register_blueprint(",))
USE = Rule(r"""\b(\w+)\.use\(\s*['"]([^'"]+)['"]\s*,\s*(\w+)\s*\)""", "i", 3, (".use(",))
DECORATOR = Rule(rf"""@(\w+)\.({VERBS})\(\s*['"]([^'"]+)['"]""", "i", 3, tuple(f".{v}(" for v in VERBS.split("|")))
API_ROUTE = Rule(r"""@(\w+)\.api_route\(\s*['"]([^'"]+)['"](.*?)\)""", "is", 3, (".api_route(",))
FLASK_ROUTE = Rule(r"""@(\w+)\.route\(\s*['"]([^'"]+)['"](.*?)\)""", "is", 3, (".route(",))
DIRECT = Rule(rf"""\b(\w+)\.({VERBS}|all)\(\s*['"]([^'"]+)['"]""", "i", 3, tuple(f".{v}(" for v in (*VERBS.split("|"), "all")))
CHAIN = Rule(r"""\b(\w+)\.route\(\s*['"]([^'"]+)['"]\s*\)([\s\S]*?)(?=(?:\n\s*\w+\.)|\z)""", "i", 3, (".route(",))
CHAIN_VERB = Rule(rf"""\.({VERBS}|all)\s*\(""", "i", 1)
METHOD = Rule(r"""['"](GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD|ALL)['"]""", "i", 1)
# The patterns of outbound calls, and of secret names that code asks its environment for.
CALLS = (
    Rule(r"""requests\.(?:get|post|put|delete|patch)\(['"]([^'"]+)['"]""", needs=("requests.",)),
    Rule(r"""axios\.(?:get|post|put|delete|patch)\(['"]([^'"]+)['"]""", needs=("axios.",)),
    Rule(r"""fetch\(['"]([^'"]+)['"]""", needs=("fetch(",)),
)
SECRETS = (
    Rule(r"""os\.getenv\(['"]([^'"]*(?:SECRET|TOKEN|KEY|PASSWORD)[^'"]*)['"]""", "i", needs=("os.getenv(",)),
    Rule(r"process\.env\.([A-Z0-9_]*(?:SECRET|TOKEN|KEY|PASSWORD)[A-Z0-9_]*)", "i", needs=("process.env.",)),
)
# Patterns and words of datastores and of authentication, with the labels they stand for.
DATABASES = (
    (Rule(r"""create_engine\(\s*['"](?:postgresql|mysql|sqlite|mssql|oracle)\+?""", "i", needs=("create_engine(",)), "sql"),
    (Rule(r"sqlite3\.connect\(", "i", needs=("sqlite3.connect(",)), "sqlite"),
    (Rule(r"psycopg(?:2)?\.connect\(", "i", needs=("psycopg",)), "postgresql"),
    (Rule(r"(?:AsyncIOMotorClient|MongoClient)\(", "i", needs=("motorclient(", "mongoclient(")), "mongodb"),
    (Rule(r"redis\.(?:Redis|StrictRedis)\(", "i", needs=("redis.",)), "redis"),
    (Rule(r"new\s+PrismaClient\(", "i", needs=("prismaclient(",)), "sql"),
    (Rule(r"mongoose\.connect\(", "i", needs=("mongoose.connect(",)), "mongodb"),
    (Rule(r"new\s+Pool\(", "i", needs=("pool(",)), "postgresql"),
)
DATABASE_WORDS = (
    ("postgres", "postgresql"), ("psycopg", "postgresql"), ("sqlalchemy", "sql"), ("mongodb", "mongodb"), ("mongo", "mongodb"), ("redis", "redis"),
    ("sqlite", "sqlite"), ("mysql", "mysql"),
)
AUTH = (
    (Rule(r"@login_required\b", "i", needs=("@login_required",)), "login_required"),
    (Rule(r"@jwt_required\b", "i", needs=("@jwt_required",)), "jwt"),
    (Rule(r"Depends\(\s*(?:oauth2_scheme|get_current_user|current_user|verify_token)\s*\)", "i", needs=("depends(",)), "depends_auth"),
    (Rule(r"OAuth2PasswordBearer\(", "i", needs=("oauth2passwordbearer(",)), "oauth"),
    (Rule(r"request\.authorization\b", "i", needs=("request.authorization",)), "authorization"),
    (Rule(r"""Authorization['"]?\s*\]""", "i", needs=("authorization",)), "authorization"),
    (Rule(r"passport\.authenticate\(", "i", needs=("passport.authenticate(",)), "passport"),
    (Rule(r"\b(?:verify|require)Token\b", "i", needs=("verifytoken", "requiretoken")), "token"),
    (Rule(r"\bauthMiddleware\b", "i", needs=("authmiddleware",)), "auth_middleware"),
)
AUTH_WORDS = ("jwt", "oauth", "auth0", "apikey", "api_key", "bearer", "session", "password", "token", "mfa")
SURE, UNSURE, SECRET_SURE, STORE_SURE = 0.85, 0.5, 0.85, 0.7

MATCH = "struct<o: int, offset: int, line: int, g1: string, g2: string, g3: string, whole: string>"


def accepted(files: DataFrame, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """Files of known suffixes (or of those given) that aren't hidden or in a folder of other people's or built code."""
    parts = F.split("file", "/")
    known = [s for s in LANGUAGES if suffixes is None or s in suffixes]
    return files.where(~F.get(parts, F.size(parts) - 1).startswith(".") & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))) & F.col("suffix").isin(*known))


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[F.col("suffix")])


def decoded(files: DataFrame) -> DataFrame:
    """Files whose binary content is UTF-8, as text with line feeds alone; others have a null content."""
    return files.withColumn("content", F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n"))


def scanned(files: DataFrame) -> DataFrame:
    """repo, languages (sorted, distinct), files_scanned of accepted files, also of those that can't be decoded."""
    rows = with_language(files).groupBy("repo")
    return rows.agg(F.array_sort(F.collect_set("language")).alias("languages"), F.count("*").alias("files_scanned"))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def clean(content: Column) -> Column:
    text = F.coalesce(content, F.lit(""))
    return F.when(has_any(text, (MARK, FIELD, END)), F.translate(text, MARK + FIELD + END, "\u0004" * 3)).otherwise(text)


#: Characters beyond ASCII that are one with an ASCII letter when case doesn't count, and these letters.
ODD, PLAIN = "\u017f\u212a\u0130\u0131", "skii"


def folded(content: Column, low: Column | None = None) -> Column:
    """The text, or low, its lower case, as patterns of any case see its ASCII letters."""
    return F.when(has_any(content, tuple(ODD)), F.lower(F.translate(content, ODD, PLAIN))).otherwise(F.lower(content) if low is None else low)


def with_low(files: DataFrame) -> DataFrame:
    """Files with their clean content, low (its lower case) and folded, by which texts without a pattern's words are told."""
    return files.withColumn("content", clean(F.col("content"))).withColumn("low", F.lower("content")).withColumn("folded", folded(F.col("content"), F.col("low")))


def may_match(content: Column, rule: Rule, fold: Column | None = None) -> Column:
    """Whether one of the words is there without which a rule has no match."""
    if not rule.needs:
        return F.lit(True)
    return has_any((folded(content) if fold is None else fold) if "i" in rule.flags else content, rule.needs)


def none() -> Column:
    return F.array().cast(f"array<{MATCH}>")


def running(sizes: Column) -> Column:
    """Sums of an array's numbers up to each, in as many rounds as doubling needs: each adds what stands further before."""
    rounds = F.when(F.size(sizes) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    far = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(rounds, sizes, lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - far(k)), F.lit(0))))


def matches(content: Column, rule: Rule, o: int = 0, fold: Column | None = None) -> Column:
    """The pattern's matches in a clean text, in order: rule's number o, offset in code points from 0, line from 1, groups.
    fold: the folded text, if it is at hand."""
    fields = FIELD.join([f"${i + 1}" for i in range(rule.groups)] + ["$0"])
    cut = F.split(F.regexp_replace(content, F.lit(rule.java()), F.lit(MARK + fields + END)), MARK, -1)
    both = lambda size, text: F.shiftleft(size.cast("long"), 32) + newlines(text)  # noqa: E731  characters and lines in one number

    def found(pieces: Column, sums: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            group = [F.get(x, F.lit(k)) if k < rule.groups else F.lit(None).cast("string") for k in range(3)]
            at = F.get(sums, i)
            return F.struct(F.lit(o).alias("o"), F.shiftright(at, 32).cast("int").alias("offset"), (at.bitwiseAND(F.lit((1 << 32) - 1)).cast("int") + 1).alias("line"), *(g.alias(f"g{k + 1}") for k, g in enumerate(group)), F.substring_index(F.get(x, F.lit(rule.groups)), END, 1).alias("whole"))

        return F.transform(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.split(p, FIELD, -1)), one)

    def summed(pieces: Column) -> Column:
        rest = lambda p: F.substring_index(p, FIELD, -1)  # noqa: E731  a match and what comes after it; the end mark isn't of the text
        sizes = F.transform(pieces, lambda p, i: both(F.length(rest(p)) - F.when(i > 0, 1).otherwise(0), rest(p)))
        return F.when(F.size(pieces) > 1, let(let(sizes, running), lambda sums: found(pieces, sums))).otherwise(none())

    found_in = let(cut, summed)
    return F.when(may_match(content, rule, fold), found_in).otherwise(none()) if rule.needs else found_in


def lines_for(content: Column, found: Column) -> Column:
    """The text's lines, if anything was found in it."""
    return F.when(F.size(found) > 0, F.split(content, "\n", -1)).otherwise(F.array().cast("array<string>"))


def line_snippet(lines: Column, line: Column, most: int = SNIPPET) -> Column:
    """A line of a text, trimmed; over most characters, its last is an ellipsis."""
    own = F.regexp_replace(F.get(lines, line - 1), r"(?U)^\s+|\s+$", "")
    return let(own, lambda x: F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most - 1)), F.lit("…"))).otherwise(x))


# Prefixes of routers, among the matches of one file


def lasts(pairs: Column) -> Column:
    """Of pairs (k, v) the last of each k, by k."""
    ordered = F.sort_array(F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v"))))
    ends = lambda xs: F.filter(xs, lambda x, i: ~F.get(xs, i + 1)["k"].eqNullSafe(x["k"]))
    return let(ordered, lambda xs: F.transform(ends(xs), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))))


def looked_up(keys: Column, pairs: Column) -> Column:
    """Of each key the v of its pair (k, v), else null, in the keys' order. Keys and pairs are sorted together: a pair stands
    before the keys that look for it, so each run of equal ones is read from its start."""
    nothing = F.when(F.lit(False), F.get(pairs, F.lit(0))["v"])
    asked = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"), nothing.alias("v")))
    known = F.transform(pairs, lambda x: F.struct(x["k"].alias("k"), F.lit(-1).alias("i"), x["v"].alias("v")))

    def answered(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda j: (j == 0) | ~F.get(xs, j)["k"].eqNullSafe(F.get(xs, j - 1)["k"]))
        run = lambda s, end: let(F.get(xs, s)["v"], lambda v: F.transform(F.sequence(s, end - 1), lambda j: F.struct(F.get(xs, j)["i"].alias("i"), v.alias("v"))))
        return let(starts, lambda ss: F.flatten(F.transform(ss, lambda s, n: run(s, F.coalesce(F.get(ss, n + 1), F.size(xs))))))

    found = F.filter(let(F.sort_array(F.concat(known, asked)), answered), lambda x: x["i"] >= 0)
    return F.when(F.size(keys) > 0, F.transform(F.sort_array(found), lambda x: x["v"]))


def pair(k: Column, v: Column) -> Column:
    return F.struct(k.alias("k"), v.alias("v"))


def field(array: str, name: str) -> Column:
    return F.transform(array, lambda x: x[name])


def empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


@cache
def router_steps() -> list[dict[str, Column]]:
    """The columns that each projection of with_routers adds or replaces; built once, as building them takes longer than a small scan."""
    content, python, script = F.col("content"), F.col("suffix") == ".py", F.col("suffix").isin(*SCRIPTS)
    some = lambda on, *found: F.when(on, F.concat(*found)).otherwise(none())
    mount = lambda x, router, extra: pair(x[router], F.struct(x["g1"].alias("parent"), empty(x[extra]).alias("extra")))
    of = lambda rule, o=0: matches(content, rule, o, F.col("folded"))
    nested = F.transform(some(python, of(INCLUDE, 0), of(REGISTER, 1)), lambda x: mount(x, "g2", "g3"))
    used = F.transform(some(script, of(USE, 2)), lambda x: mount(x, "g3", "g2"))
    local = F.transform(some(python, of(ROUTER, 0), of(BLUEPRINT, 1)), lambda x: pair(x["g1"], empty(x["g2"])))
    walk = lambda own_of: F.transform("edges", lambda e, i: F.struct(e["k"].alias("router"), e["v"]["parent"].alias("at"), join_route_parts(e["v"]["extra"], empty(F.get(own_of, i))).alias("path")))

    def further(walk: Column, _: Column) -> Column:
        """Each walk goes on with the walk of the router it has come to."""
        ways = F.transform(walk, lambda x: pair(x["router"], F.struct(x["at"].alias("at"), x["path"].alias("path"))))
        longer = lambda x, up: F.when(up.isNull(), x).otherwise(F.struct(x["router"].alias("router"), up["at"].alias("at"), join_normal(up["path"], x["path"]).alias("path")))
        return let(looked_up(F.transform(walk, lambda x: x["at"]), ways), lambda ups: F.transform(walk, lambda x, i: longer(x, F.get(ups, i))))

    rounds = F.when(F.size("walk") > 0, F.sequence(F.lit(1), F.ceil(F.log2(F.size("walk") + F.lit(2))).cast("int"))).otherwise(F.array().cast("array<int>"))
    at = field("walk", "at")
    prefix = lambda x, i, own_of, above, top: F.when(F.get(above, i).isNull(), join_route_parts(empty(F.get(top, i)), x["path"])).otherwise(empty(F.get(own_of, i)))
    under = let(F.struct("own_of", "above", "top"), lambda s: F.transform("walk", lambda x, i: pair(x["router"], prefix(x, i, s["own_of"], s["above"], s["top"]))))
    alone = let(F.col("mounted"), lambda m: F.filter("own", lambda x, i: F.get(m, i).isNull()))
    return [
        {"own": lasts(local), "edges": lasts(F.concat(nested, used))},
        {"own_of": looked_up(field("edges", "k"), F.col("own"))},
        {"walk": let(F.col("own_of"), walk)},
        {"walk": F.aggregate(rounds, F.col("walk"), further)},
        {"above": looked_up(at, F.col("edges")), "top": looked_up(at, F.col("own")), "mounted": looked_up(field("own", "k"), F.col("edges"))},
        {"known": F.concat(under, alone)},
    ]


def with_routers(files: DataFrame, *kept: str) -> DataFrame:
    """kept, suffix, content (clean), low, folded, and `known`: pairs (k, v) of a file's routers and their prefixes.

    The last mount of a router counts. A router's mounts are walked up to the one that is mounted nowhere: every round
    doubles the mounts that a walk has passed. One that ends at a mounted router is in a cycle, and keeps its own prefix.
    Each step is a projection of the same rows, as deeply nested functions are slow to plan.
    """
    df = with_low(files.select(*kept, "suffix", "content"))
    kept = (*kept, "suffix", "content", "low", "folded")
    for columns in router_steps():
        df = df.withColumns(columns)
    return df.select(*kept, "known")


def prefixes(files: DataFrame) -> DataFrame:
    """repo, file, router, prefix: what the mounts above a router and its own prefix make together."""
    return rows_of(with_routers(files, "repo", "file").select("repo", "file", F.transform("known", lambda x: F.struct(x["k"].alias("router"), x["v"].alias("prefix"))).alias("known")), "known", "router")


# Routes


def verb(m: Column) -> Column:
    return F.when(F.upper(m) == "ALL", "ANY").otherwise(F.upper(m))


def methods(args: Column, default: str) -> Column:
    """Upper-case verbs listed in args, ALL as ANY; the default where none is."""
    found = F.transform(F.regexp_extract_all(args, F.lit(METHOD.java()), F.lit(1)), verb)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


@cache
def route_steps() -> list[dict[str, Column]]:
    """The columns of with_routes, like router_steps."""
    content, python, script = F.col("content"), F.col("suffix") == ".py", F.col("suffix").isin(*SCRIPTS)
    row = lambda x, raw, method, o, line=None, offset=None: F.struct(
        x["g1"].alias("router"),
        raw.alias("raw"),
        method.alias("method"),
        (x["line"] if line is None else line).alias("line"),
        F.lit(o).alias("o"),
        (x["offset"] if offset is None else offset).alias("offset"),
    )
    of = lambda rule: matches(content, rule, 0, F.col("folded"))
    listed = lambda rule, default, o: F.flatten(F.transform(of(rule), lambda x: F.transform(methods(x["g3"], default), lambda m: row(x, x["g2"], m, o))))

    def chained(x: Column) -> Column:
        begin, lines = x["offset"] + F.length(x["whole"]) - F.length(x["g3"]), x["line"] - 1 + newlines(x["whole"]) - newlines(x["g3"])
        return F.transform(matches(x["g3"], CHAIN_VERB), lambda v: row(x, x["g2"], verb(v["g1"]), 4, lines + v["line"], begin + v["offset"]))

    nothing = F.array().cast("array<struct<router: string, raw: string, method: string, line: int, o: int, offset: int>>")
    rows = F.concat(
        F.when(python, F.transform(of(DECORATOR), lambda x: row(x, x["g3"], F.upper(x["g2"]), 0))).otherwise(nothing),
        F.when(python, listed(API_ROUTE, "ANY", 1)).otherwise(nothing),
        F.when(python, listed(FLASK_ROUTE, "GET", 2)).otherwise(nothing),
        F.when(script, F.transform(of(DIRECT), lambda x: row(x, x["g3"], verb(x["g2"]), 3))).otherwise(nothing),
        F.when(script, F.flatten(F.transform(of(CHAIN), chained))).otherwise(nothing),
    )
    path = lambda prefix, x: F.struct(join_route_parts(empty(prefix), x["raw"]).alias("path"), x["method"].alias("method"), x["line"].alias("line"), x["o"].alias("o"), x["offset"].alias("offset"))
    whole = let(F.col("before"), lambda before: F.transform("routes", lambda x, i: path(F.get(before, i), x)))
    return [{"routes": rows}, {"before": looked_up(field("routes", "router"), F.col("known"))}, {"routes": whole}]


def with_routes(files: DataFrame, *kept: str) -> DataFrame:
    """kept, content (clean), low, folded, and routes: array<struct<path, method, line, o, offset>> of each file."""
    df = with_routers(files, *kept)
    for columns in route_steps():
        df = df.withColumns(columns)
    return df.select(*kept, "content", "low", "folded", "routes")


@cache
def call_marks() -> Column:
    return listed_of(F.col("content"), CALLS)


@cache
def secret_marks() -> Column:
    return listed_of(F.col("content"), SECRETS)


@cache
def store_marks() -> Column:
    return marks_of(F.col("content"), DATABASES, DATABASE_WORDS, STORE_SURE, STORE_SURE)


@cache
def auth_marks() -> Column:
    return marks_of(F.col("content"), AUTH, tuple((w, w) for w in AUTH_WORDS), SURE, UNSURE)


def rows_of(df: DataFrame, found: str, never_null: str) -> DataFrame:
    """repo, file and the fields of an array's structs, a row for each. Rows of empty arrays go afterwards: a filter on the
    array itself would be planned as one on the text, with the array's whole expression once more."""
    return df.select("repo", "file", F.inline_outer(found)).where(F.col(never_null).isNotNull())


def said(files: DataFrame, marks: Column) -> DataFrame:
    """repo, file and the columns of marks in the clean content, a row for each."""
    return rows_of(with_low(files.select("repo", "file", "content")).select("repo", "file", marks.alias("marks")), "marks", "line")


def listed_of(content: Column, rules: tuple[Rule, ...]) -> Column:
    """array<struct<value, line, evidence, o, offset>>: group 1 of the rules' matches, with the line they are on."""
    found = F.concat(*(matches(content, r, o, F.col("folded")) for o, r in enumerate(rules)))
    row = lambda lines, x: F.struct(x["g1"].alias("value"), x["line"].alias("line"), line_snippet(lines, x["line"]).alias("evidence"), x["o"].alias("o"), x["offset"].alias("offset"))
    return let(found, lambda xs: let(lines_for(content, xs), lambda lines: F.transform(xs, lambda x: row(lines, x))))


def marks_of(content: Column, rules: tuple[tuple[Rule, str], ...], words: tuple[tuple[str, str], ...], sure: float, unsure: float) -> Column:
    """array<struct<label, line, evidence, confidence, o, offset>>: the first match of each pattern, then the first place of
    each word; of a label, the first of these counts."""
    row = lambda label, sure_, o, before: F.struct(
        F.lit(label).alias("label"),
        (newlines(before) + 1).alias("line"),
        F.lit(sure_).alias("confidence"),
        F.lit(o).alias("o"),
        F.length(before).alias("offset"),
    )

    def by_rule(rule: Rule, label: str, o: int) -> Column:
        first = let(F.split(content, rule.java(), 2), lambda x: F.when(F.size(x) > 1, row(label, sure, o, F.get(x, F.lit(0)))))
        return F.when(may_match(content, rule, F.col("folded")), first)

    def by_word(word: str, label: str, o: int) -> Column:
        first = let(F.substring(content, F.lit(1), F.instr(F.col("low"), word) - 1), lambda before: row(label, unsure, o, before))
        return F.when(F.col("low").contains(word), first)

    each = [by_rule(r, label, o) for o, (r, label) in enumerate(rules)] + [by_word(w, label, 100 + o) for o, (w, label) in enumerate(words)]
    first = lambda xs: F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, F.lit(1), i), lambda y: y["label"] == x["label"]))
    shown = lambda lines, x: F.struct(
        x["label"].alias("label"),
        x["line"].alias("line"),
        line_snippet(lines, x["line"]).alias("evidence"),
        x["confidence"].alias("confidence"),
        x["o"].alias("o"),
        x["offset"].alias("offset"),
    )
    return let(F.array_compact(F.array(*each)), lambda xs: let(lines_for(content, xs), lambda lines: F.transform(first(xs), lambda x: shown(lines, x))))


def place(file: Column, x: str = "") -> Column:
    """Order of a fact in its repository: by file, rule and offset."""
    return F.struct(file.alias("file"), F.col(f"{x}o").alias("o"), F.col(f"{x}offset").alias("offset")).alias("seq")


def extract_routes(files: DataFrame) -> DataFrame:
    """repo, path, method, file, line, seq of all routes of both families."""
    rows = rows_of(with_routes(files, "repo", "file").select("repo", "file", "routes"), "routes", "line")
    return rows.select("repo", "path", "method", "file", "line", place(F.col("file")))


def extract_calls(files: DataFrame) -> DataFrame:
    """repo, target, file, line, evidence of literal outbound targets."""
    rows = said(files, call_marks())
    return rows.select("repo", F.col("value").alias("target"), "file", "line", "evidence")


def extract_secrets(files: DataFrame) -> DataFrame:
    """repo, name, file, line, evidence of secret names that code asks its environment for."""
    rows = said(files, secret_marks())
    return rows.select("repo", F.col("value").alias("name"), "file", "line", "evidence")


def extract_databases(files: DataFrame) -> DataFrame:
    """repo, kind, file, line, by_word (whether a word tells, not a pattern) of datastores, each once a file."""
    rows = said(files, store_marks())
    return rows.select("repo", F.col("label").alias("kind"), "file", "line", (F.col("o") >= 100).alias("by_word"))


def extract_auth(files: DataFrame) -> DataFrame:
    """repo, hint, file, line, confidence: sure by a pattern, unsure by a word."""
    rows = said(files, auth_marks())
    return rows.select("repo", F.col("label").alias("hint"), "file", "line", "confidence")


def facts(files: DataFrame, *more: str) -> DataFrame:
    """repo, file, more, and arrays of all that each file says, in projections over its text alone."""
    marks = {"calls": call_marks(), "stores": store_marks(), "auth": auth_marks(), "secrets": secret_marks()}
    return with_routes(files, "repo", "file", *more).select("repo", "file", *more, "routes", *(c.alias(n) for n, c in marks.items()))


def scan_files(files: DataFrame) -> Scan:
    """The scan of accepted, decoded files. What they say is written once, so their texts are read once."""
    return scan_of(settled(facts(files.where("content is not null")), "facts"), files.select("repo").distinct())


def scan_of(known: DataFrame, repos: DataFrame) -> Scan:
    """The scan that facts make; all families but routes with evidence, the line that says so."""
    rows = lambda name, *columns: known.select("repo", "file", F.inline(name)).select("repo", *columns, place(F.col("file")))
    return Scan(
        repos,
        rows("routes", "path", "method", "file", "line"),
        rows("calls", F.col("value").alias("target"), "file", "line", "evidence"),
        rows("stores", F.col("label").alias("kind"), "file", "line", "evidence"),
        rows("auth", F.lit("auth").alias("family"), F.col("label").alias("hint"), "file", "line", "confidence", "evidence"),
        rows("secrets", F.col("value").alias("name"), "file", "line", F.lit(SECRET_SURE).alias("confidence"), "evidence"),
    )
