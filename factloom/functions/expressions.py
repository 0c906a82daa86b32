"""Column expressions that many operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Path parts that mark code which doesn't run in production.
LOW_QUALITY = ("/tests/", "/__tests__/", "/fixtures/", "/mocks/", "/examples/")
LOW_QUALITY_MORE = (*LOW_QUALITY, "/test_", "/_test.")


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether text contains any of parts; unrolled, so that it stays within generated code."""
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def starts_with_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.startswith(p)
    return found


def wrapped(path: Column) -> Column:
    return F.concat(F.lit("/"), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lit("/"))


def low_quality(path: Column) -> Column:
    """Test, fixture, mock and example code, as chains, findings, paths and reviews see it."""
    return has_any(wrapped(path), LOW_QUALITY)


def low_quality_ext(path: Column) -> Column:
    """The same with test files by name, as assets and secret insights see it."""
    return has_any(wrapped(path), LOW_QUALITY_MORE)


def location(file: Column, line: Column) -> Column:
    """file:line, or file where the line isn't known."""
    return F.concat_ws(":", file, line.cast("string"))


def module_of(file: Column) -> Column:
    """The file's folder, or the file itself."""
    return F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), "/[^/]*$", "")


def service_from_path(file: Column) -> Column:
    """The segment after the first of services, packages and apps, in this order of preference; else null."""
    parts = F.split(F.replace(file, F.lit("\\"), F.lit("/")), "/")
    found = [F.lower(F.get(parts, F.array_position(parts, p).cast("int"))) for p in ("services", "packages", "apps")]
    return F.coalesce(*(F.when(F.array_contains(parts, p), f) for p, f in zip(("services", "packages", "apps"), found, strict=True)))


def module_key(file: Column) -> Column:
    """module/<name> below a module folder, else the first segment; lower-cased."""
    path = F.replace(file, F.lit("\\"), F.lit("/"))
    named = F.regexp_extract(path, "/module/([^/]+)", 1)
    return F.when(named != "", F.concat(F.lit("module/"), F.lower(named))).otherwise(F.lower(F.split(path, "/")[0]))


def xrpc_namespace(path: Column) -> Column:
    value = F.regexp_extract(path, "(?s)/xrpc/(.*)", 1)
    value = F.regexp_replace(value, "^/+|/+$", "")
    return F.when(value.startswith("com.atproto."), "com.atproto").when(value.startswith("app.bsky."), "app.bsky")


def guess_action(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("/admin"), "admin action").when(low.contains("/api"), "api action").when(low.startswith("/s/") | low.contains("/site"), "site action")


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(9)
    for i, x in reversed(list(enumerate(order))):
        out = F.when(value == x, i).otherwise(out)
    return out


def even(x: Column, digits: int) -> Column:
    """x rounded to digits, halves to even; millionths first, so that binary noise doesn't decide."""
    return F.bround(F.bround(x, 6), digits)


def sorted_set(value: str | Column) -> Column:
    return F.array_sort(F.collect_set(value))


def first_rows(df: DataFrame, keys: list[str], order: list[str | Column], n: int = 1) -> DataFrame:
    """The first n rows of each key, with their place (1 first) as rn; Spark limits groups before it shuffles."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def with_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with n, how many rows share a row's keys (nulls are equal): counted in partial aggregates, so no key's rows are
    gathered in one task."""
    sizes = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("*").alias("n"))
    return df.join(sizes, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))).drop(*(f"_{k}" for k in keys))


def first_values(df: DataFrame, keys: list[str], value: Column, n: int, name: str) -> DataFrame:
    """The first n distinct values of each key in their order, as an array; cut before they are gathered."""
    distinct = df.select(*keys, value.alias("_v")).where("_v is not null").distinct()
    few = first_rows(distinct, keys, ["_v"], n)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias(name))


def top_text(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, n: int, name: str, sep: str = " | ") -> DataFrame:
    """The values of the first n rows of each key, joined in order."""
    return in_order(first_rows(df.withColumn("_v", value), keys, order, n), keys, name, sep)


def in_order(few: DataFrame, keys: list[str], name: str, sep: str = " | ") -> DataFrame:
    """The values _v of each key's rows, joined in order of rn."""
    return few.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "_v"))), lambda x: x["_v"]), sep).alias(name))


def normalize_path(path: Column) -> Column:
    """Trimmed, with one slash in front and none doubled."""
    return F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(F.coalesce(path, F.lit("")), r"^\s+|\s+$", "")), "/+", "/")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: as the only element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def join_normal(base: Column, rest: Column) -> Column:
    """Two normal paths as one, which is normal again."""
    return F.when(base == "/", rest).when(rest == "/", base).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(rest, F.lit("/"))))


def join_route_parts(prefix: Column, path: Column) -> Column:
    parts = F.struct(normalize_path(prefix).alias("base"), normalize_path(path).alias("rest"))
    return let(parts, lambda x: join_normal(x["base"], x["rest"]))
