"""URL filters: rules by host and path, and for the rest an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host, registered domain (the suffix and one name more) and suffix (the
last name, or the last two where these are in the list of suffixes given). Each level's bad rate is shrunk towards the level above through a beta-binomial prior, whose mean is the upper
level's shrunk rate and whose strength is estimated from how much the level's rates spread beyond chance (by moments).
The host's posterior is a beta distribution; a page is blocked where even the lower bound of its host's bad rate,
``Z`` standard deviations below the mean, is above ``limit``. Only counts are shuffled, after partial counts; hosts
without labelled pages have their domain's rate, and unknown domains their suffix's, and unknown suffixes the overall
rate, with wide bounds: those of the prior, whose variance adds up the spread of every level that wasn't seen. Pages are
joined with their hosts' bounds by host; hosts with over a thousandth of all pages, of which there are fewer than a
thousand, are dealt over many tasks by their paths and ids.

Edge cases: a null url, or one without ``://``, has an empty host and path, which no rule fits; the pages of the empty host
are judged by their own outcomes like those of any other, under an empty domain and suffix; repeated rows are judged each; several labels of a page count each; without labels nothing is blocked but by
rules; pages without an id count as not labelled.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import joined_hot, written

Rule = tuple[str, str, str]  # host, path, verdict

LIMIT = 0.2
Z = 1.645
# Suffixes of two names under which domains are registered.
SUFFIXES = frozenset("co.uk org.uk ac.uk gov.uk ltd.uk me.uk com.au net.au org.au edu.au gov.au co.nz org.nz ac.nz co.jp ne.jp or.jp ac.jp go.jp com.br net.br org.br gov.br com.cn net.cn org.cn gov.cn edu.cn com.mx org.mx co.in net.in org.in ac.in gov.in co.za org.za co.kr or.kr ac.kr com.tr org.tr com.ar com.tw org.tw com.hk org.hk com.sg edu.sg com.my co.id or.id co.th in.th com.vn com.ph com.pl org.pl net.pl com.ua com.ru co.il org.il ac.il com.eg com.ng co.ke com.pk com.bd com.co com.pe com.ve com.uy com.ec com.es org.es nom.es com.pt com.gr com.cy com.mt".split())


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    pattern = r"://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def fitting(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def strength(level: DataFrame) -> float:
    """The prior's weight in pages, from the spread of level's (n, k, mean) beyond chance; between 2 and 999."""
    noise = F.col("mean") * (1 - F.col("mean"))
    spread = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("mean"), F.lit(2)))
    s, chance, room = level.agg(spread, F.sum(noise), F.sum(noise * (F.col("n") - 1))).first()
    return 1 / min(max((s - chance) / room, 0.001), 1 / 3) - 1 if room else 999.0


def lower(mean: Column, weight: Column | float) -> Column:
    """Z standard deviations below the mean of a beta distribution of so much weight."""
    return mean - Z * F.sqrt(mean * (1 - mean) / (weight + 1))


def unseen(*strengths: float) -> float:
    """The weight of the one prior with the variance of nested priors: 1 / (weight + 1) is 1 less the product of m / (m + 1)."""
    kept = math.prod(m / (m + 1) for m in strengths)
    return kept / (1 - kept)


def suffix_of(host: Column, suffixes: frozenset[str]) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*sorted(suffixes)), two).otherwise(F.substring_index(host, ".", -1)) if suffixes else F.substring_index(host, ".", -1)


def domain_of(host: Column, suffixes: frozenset[str]) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*sorted(suffixes)), F.substring_index(host, ".", -3)).otherwise(two) if suffixes else two


def reputations(hosts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float | None]]:
    """Of hosts (host, domain, suffix, n, k): by host, domain, suffix, and overall, the shrunk bad rate and the lower bound
    of a host's."""
    n, k = hosts.agg(F.sum("n"), F.sum("k")).first()
    overall = ((k or 0) + 0.5) / ((n or 0) + 1)

    def rate(m: float) -> Column:
        return (F.col("k") + m * F.col("mean")) / (F.col("n") + m)

    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("mean", F.lit(overall))
    of_suffix = strength(suffixes)
    suffixes = suffixes.select("suffix", rate(of_suffix).alias("suffix_rate"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = domains.join(suffixes, "suffix").withColumnRenamed("suffix_rate", "mean")
    of_domain = strength(domains)
    domains = domains.select("domain", rate(of_domain).alias("domain_rate"))
    own = hosts.join(domains, "domain").withColumnRenamed("domain_rate", "mean")
    m = strength(own)
    own = own.select("host", rate(m).alias("host_rate"), lower(rate(m), F.col("n") + m).alias("host_bound"))
    domains = domains.withColumn("domain_bound", lower(F.col("domain_rate"), m))
    suffixes = suffixes.withColumn("suffix_bound", lower(F.col("suffix_rate"), unseen(m, of_domain)))
    any_bound = overall - Z * math.sqrt(overall * (1 - overall) / (unseen(m, of_domain, of_suffix) + 1))
    return own, domains, suffixes, (overall, any_bound if n else None)


def url_filters(
    pages: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT, suffixes: frozenset[str] = SUFFIXES
) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bound of every row of pages; labels: page_id, bad (0 or 1)."""
    host, path = parts(F.col("url"))
    judged = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    given = labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("long").alias("bad")).where("bad is not null")
    counted = judged.select("page_id", "host").join(given, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    names = {"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}
    hosts, domains, ends, (overall, any_bound) = reputations(written(counted.withColumns(names), "outcomes"))
    # The rate and bound belong to the host: they are joined to the distinct hosts, then to the pages.
    own = written(judged.groupBy("host").agg(F.count("*").alias("pages")).withColumns(names), "hosts")
    total = own.agg(F.sum("pages")).first()[0] or 0
    known = own.join(hosts, "host", "left").join(domains, "domain", "left").join(ends, "suffix", "left")
    bound = F.coalesce("host_bound", "domain_bound", "suffix_bound", F.lit(any_bound).cast("double"))
    known = known.select("host", F.coalesce("host_rate", "domain_rate", "suffix_rate", F.lit(overall)).alias("bad_rate"), bound.alias("bound"), F.col("pages").alias("n"))
    name, verdict = fitting(F.col("host"), F.col("path"), rules)
    blocked = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return joined_hot(judged, known, "host", ("page_id", "path"), total).select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, blocked).alias("verdict"), "bad_rate", "bound")
