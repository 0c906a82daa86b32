"""Ranking: weighted scores of surfaces, paths and findings, and where evidence comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.expressions import even, first_rows, has_any, low_quality, rank_of
from factloom.operators.threats import SEVERITIES

# Weight of a surface's category.
PRIVILEGE = (("admin", 3.0), ("auth", 3.0), ("webhook", 2.0), ("upload", 2.0), ("public_api", 1.5), ("internal", 1.0), ("health", 0.5))
PRIVILEGED_WORDS = ("admin", "privileged", "authorization", "authz", "token", "identity")
HOP_WORDS = ("propagation", "service", "edge", "external", "config risk", "sink")


def protocol_derived() -> Column:
    return F.lower("file").contains("lexicon") | F.lower("route").contains("/xrpc/") | F.col("protocol_auth")


def provenance() -> Column:
    """low_quality, protocol_derived, observed_runtime or other."""
    return F.when(low_quality(F.col("file")), "low_quality").when(protocol_derived(), "protocol_derived").when(F.col("exposure") == "public", "observed_runtime").otherwise("other")


def entrypoint_class() -> Column:
    """Each surface in the first of low_quality, internal_only, protocol_derived and runtime_public that fits."""
    return F.when(low_quality(F.col("file")), "low_quality").when(F.col("exposure") == "internal", "internal_only").when(protocol_derived(), "protocol_derived").when(F.col("exposure") == "public", "runtime_public")


SOURCES = ("observed_runtime", "protocol_derived", "low_quality")


def shares(surfaces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, a count of each provenance, and pct_ of each: whole percentages, halves to even."""
    g = surfaces.withColumn("_p", provenance()).groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col("_p") == k).alias(k) for k in SOURCES))
    return g.withColumns({f"pct_{k}": F.bround(F.col(k) / F.col("n") * 100).cast("int") for k in SOURCES})


def basis_label() -> Column:
    """What half of the counted surfaces rest on."""
    total = F.greatest(F.col("observed_runtime") + F.col("protocol_derived") + F.col("low_quality"), F.lit(1))
    share = lambda k: F.col(k) / total * 100
    return F.when(share("observed_runtime") >= 50, "observed").when(share("protocol_derived") >= 50, "inferred-protocol").when(share("low_quality") >= 50, "low-quality-evidence").otherwise("mixed-evidence")


def provenance_shares(surfaces: DataFrame) -> DataFrame:
    """repo, observed, protocol, low (whole percentages, halves to even), basis."""
    names = dict(zip(SOURCES, ("observed", "protocol", "low"), strict=True))
    return shares(surfaces, ["repo"]).select("repo", *(F.col(f"pct_{k}").alias(n) for k, n in names.items()), basis_label().alias("basis"))


def summed(factors: dict[str, Column]) -> tuple[Column, Column]:
    """The factors as an array of name and value, and their sum in order, halves to even."""
    listed = F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in factors.items()))
    return listed, even(F.aggregate("factors", F.lit(0.0), lambda a, x: a + x["value"]), 2)


def top_reasons(factors: Column, n: int) -> Column:
    """The n greatest factors (array of name and value), those above zero, as name=value; ties in their order."""
    keyed = F.transform(factors, lambda x, i: F.struct((-x["value"]).alias("down"), i.alias("i"), x["name"].alias("name")))
    best = F.filter(F.slice(F.array_sort(keyed), 1, n), lambda x: x["down"] < 0)
    return F.array_join(F.transform(best, lambda x: F.concat(x["name"], F.lit("="), F.format_string("%.1f", even(-x["down"], 1)))), ", ")


def surface_scores(surfaces: DataFrame) -> DataFrame:
    """Surfaces with a score; terms are added in a fixed order, as doubles."""
    public = F.col("exposure") == "public"
    one = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    privilege = F.lit(1.0)
    for k, w in PRIVILEGE:
        privilege = F.when(F.col("category") == k, F.lit(w)).otherwise(privilege)
    both = one(F.col("data_store"), 2.0, 0.0) + one(F.col("outbound"), 2.0, 0.0)
    quality = F.when(low_quality(F.col("file")), F.lit(-8.0)).when(protocol_derived(), F.lit(-3.0)).when(public, F.lit(1.0)).otherwise(F.lit(0.0))
    listed, total = summed(
        {
            "exposure": one(public, 6.0, 2.0),
            "privilege": privilege * 2.0,
            "reachability": one(public, 3.0, 1.5),
            "trust_boundary": both * 1.5,
            "chain_depth": one(F.col("data_store") & F.col("outbound"), 2.0, 1.0),
            "confidence": one(F.col("guarded"), 2.0, 1.0),
            "source_quality": quality,
        }
    )
    scored = surfaces.withColumn("factors", listed).withColumns({"score": total, "reasons": top_reasons(F.col("factors"), 2)})
    return scored.withColumn("provenance", provenance()).drop("factors")


def top_hotspots(surfaces: DataFrame, n: int = 2) -> DataFrame:
    """repo, place, method, route, category, score: the highest scores; then risk, then the route from the end."""
    order = [F.desc("score"), rank_of(F.col("risk"), SEVERITIES), F.desc("route"), "seq"]
    return first_rows(surface_scores(surfaces), ["repo"], order, n).select("repo", F.col("rn").alias("place"), "method", "route", "category", "score")


def path_scores(paths: DataFrame) -> DataFrame:
    """Attack paths (repo, place, name, steps) with a score."""
    said = F.lower(F.concat_ws(" ", F.col("name"), F.array_join("steps", " ")))
    exposure = F.when(has_any(said, ("attacker reaches", "public", "/xrpc/")), 3.0).otherwise(2.0)
    privilege = F.when(has_any(said, PRIVILEGED_WORDS), 3.0).otherwise(1.5)
    reach = F.when(F.exists("steps", lambda s: F.lower(s).startswith("entry:")), 2.0).otherwise(1.0)
    hops = F.size(F.filter("steps", lambda s: has_any(F.lower(s), HOP_WORDS))) + F.lit(1.0)
    depth = F.greatest(F.lit(1.0), F.least(F.size("steps"), F.lit(8)) / F.lit(2.0))
    known = F.regexp_extract(said, r"confidence=([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    quality = F.when(low_quality(said), -10.0).otherwise(0.0)
    listed, total = summed(
        {
            "exposure": exposure * 2.0,
            "privilege": privilege * 2.0,
            "reachability": reach * 1.5,
            "trust_boundary": hops * 2.0,
            "chain_depth": depth * 1.2,
            "confidence": (F.coalesce(known, F.lit(0.5)) + 1.5) * 1.5,
            "source_quality": quality,
        }
    )
    return paths.withColumn("factors", listed).withColumns({"score": total, "reasons": top_reasons(F.col("factors"), 3)}).drop("factors")
