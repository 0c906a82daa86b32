"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import co_training, filter_audit, html_extraction, merkle, nearest, ngram_join, order_minhash, packing, pieces, quality_rules, suffix_dedup, toxicity, url_filters
from factloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def byte_bpe() -> str:
    """Place of the vocabulary that the packing query uses; the operator takes any."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), byte_bpe())


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.html_extraction(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_array_dedup(table(spark, sf_dir, "documents"))


def piece_model() -> str:
    """Place of the model that the piece query uses; the operator takes any."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), piece_model())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_training.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Rules of the URL query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of its id: bad if 0."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_filters.url_filters(table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS r FROM pairs)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

URL_SQL = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), names AS (
  SELECT DISTINCT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix FROM p
), h AS (
  SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, sum(1 - quality)::DOUBLE AS k
  FROM p JOIN names USING (host) JOIN labels l ON l.doc_id = p.page_id WHERE quality IS NOT NULL GROUP BY host
), o AS (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS mean, count(*) AS seen FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(mean) AS mean FROM h, o GROUP BY suffix),
sm AS (SELECT sum(n * power(k / n - mean, 2)) AS s, sum(mean * (1 - mean)) AS c, sum(mean * (1 - mean) * (n - 1)) AS r FROM s),
sw AS (SELECT CASE WHEN r > 0 THEN 1 / least(greatest((s - c) / r, 0.001), 1.0 / 3) - 1 ELSE 999 END AS m FROM sm),
sr AS (SELECT suffix, (k + m * mean) / (n + m) AS rate FROM s, sw),
d AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(rate) AS mean FROM h JOIN sr USING (suffix) GROUP BY domain),
dm AS (SELECT sum(n * power(k / n - mean, 2)) AS s, sum(mean * (1 - mean)) AS c, sum(mean * (1 - mean) * (n - 1)) AS r FROM d),
dw AS (SELECT CASE WHEN r > 0 THEN 1 / least(greatest((s - c) / r, 0.001), 1.0 / 3) - 1 ELSE 999 END AS m FROM dm),
dr AS (SELECT domain, (k + m * mean) / (n + m) AS rate FROM d, dw),
g AS (SELECT host, n, k, rate AS mean FROM h JOIN dr USING (domain)),
gm AS (SELECT sum(n * power(k / n - mean, 2)) AS s, sum(mean * (1 - mean)) AS c, sum(mean * (1 - mean) * (n - 1)) AS r FROM g),
gw AS (SELECT CASE WHEN r > 0 THEN 1 / least(greatest((s - c) / r, 0.001), 1.0 / 3) - 1 ELSE 999 END AS m FROM gm),
-- variance of a beta distribution as a share of mean * (1 - mean): nested priors leave the product of m / (m + 1) of it certain
posterior AS (
  SELECT names.host,
    CASE WHEN g.host IS NOT NULL THEN (g.k + gw.m * g.mean) / (g.n + gw.m) WHEN dr.domain IS NOT NULL THEN dr.rate WHEN sr.suffix IS NOT NULL THEN sr.rate WHEN o.seen > 0 THEN o.mean END AS mean,
    CASE WHEN g.host IS NOT NULL THEN 1 / (g.n + gw.m + 1) WHEN dr.domain IS NOT NULL THEN 1 / (gw.m + 1) WHEN sr.suffix IS NOT NULL THEN 1 - gw.m / (gw.m + 1) * (dw.m / (dw.m + 1))
      ELSE 1 - gw.m / (gw.m + 1) * (dw.m / (dw.m + 1)) * (sw.m / (sw.m + 1)) END AS spread
  FROM names CROSS JOIN gw CROSS JOIN dw CROSS JOIN sw CROSS JOIN o LEFT JOIN g USING (host) LEFT JOIN dr ON dr.domain = names.domain LEFT JOIN sr ON sr.suffix = names.suffix
), bound AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) * spread) AS bound FROM posterior),
rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT host, path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(verdict, length(r.h || r.p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) u JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN bound > 0.2 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON best.host = p.host AND best.path = p.path LEFT JOIN bound ON bound.host = p.host
"""


def merkle_sql(levels: int = 8) -> str:
    """The manifest in SQL, for sources, and rows of a source, of up to 16^levels."""
    field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # crc32 of the decimal id, byte by byte and bit by bit
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, first: str) -> str:
        """Levels {name}0..: grp, r, h, m; runs with the digests of their nodes, in order."""
        out = [f"{name}0 AS ({first})"]
        for k in range(levels):
            out.append(f"{name}r{k} AS (SELECT grp, r // 16 AS up, any_value(m) AS m, list(h ORDER BY r) AS hs FROM {name}{k} GROUP BY grp, up)")
            out.append(f"{name}{k + 1} AS (SELECT grp, up AS r, CASE WHEN m = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (m + 15) // 16 AS m FROM {name}r{k})")
        return ", ".join(out)

    def folded(name: str, start: str, keep: str) -> str:
        """{name}f{levels}: of each node its digest with all siblings (b) and the folded one (f)."""
        out = [f"{name}f0 AS ({start})"]
        for k in range(levels):
            near = f"{name}r{k}.hs"
            left, right = f"array_to_string(list_slice({near}, 1, pos % 16), '')", f"array_to_string(list_slice({near}, pos % 16 + 2, 16), '')"
            step = f"CASE WHEN m = 1 THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN m = 1 THEN b ELSE b || {left} || {right} END AS b"
            out.append(f"{name}f{k + 1} AS (SELECT {keep}, p.grp, pos // 16 AS pos, {step} FROM {name}f{k} p JOIN {name}r{k} ON p.grp = {name}r{k}.grp AND pos // 16 = up)")
        return ", ".join(out)

    return f"""
WITH l AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS changed FROM documents
), ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY grp) AS m FROM l),
{tree("t", "SELECT grp, r, leaf AS h, m FROM ranked")},
s AS (SELECT grp AS source, h, row_number() OVER (ORDER BY grp::BLOB) - 1 AS r, count(*) OVER () AS m FROM t{levels}),
{tree("u", "SELECT '' AS grp, r, h, m FROM s")},
{folded("t", "SELECT doc_id, leaf, grp AS source, grp, r AS pos, changed AS f, '' AS b FROM ranked", "doc_id, leaf, source")},
{folded("u", f"SELECT doc_id, leaf, tf{levels}.source, s.h AS subroot, '' AS grp, s.r AS pos, f, b FROM tf{levels} JOIN s ON s.source = tf{levels}.source", "doc_id, leaf, source, subroot")}
SELECT doc_id, leaf, subroot, u{levels}.h AS root, sha256(b) AS proof_sha256, f AS folded_root, f = u{levels}.h AS verified FROM uf{levels}, u{levels}
"""


AUDIT_SQL = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
k AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN k USING (doc_id)
),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
f AS (SELECT unnest(string_split('ABCDE', '')) AS f),
orders AS (SELECT a.f || b.f || c.f || x.f || y.f AS o FROM f a, f b, f c, f x, f y WHERE len(list_distinct([a.f, b.f, c.f, x.f, y.f])) = 5),
steps AS (SELECT o, k AS step, o[k] AS f, o[1:k - 1] AS before FROM orders, range(1, 6) r(k)),
s AS (
  SELECT part, o AS filter_order, step, f,
    CASE WHEN contains(fails, f) THEN 1 ELSE 0 END AS fail, CASE WHEN translate(fails, before, '') <> fails THEN 1 ELSE 0 END AS gone, fails = f AS alone, good, toxic, n
  FROM g, steps
),
r AS (
  SELECT part, filter_order, step, f, sum(n * (1 - fail) * (1 - gone)) AS kept, sum(n * fail * (1 - gone)) AS removed, sum(n * fail * gone) AS redundant,
    coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(n * fail * (1 - gone)) FILTER (good), 0) AS good_lost, coalesce(sum(n * fail * (1 - gone)) FILTER (toxic), 0) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_ngram_jaccard_join, op3_nearest, op4_best_fit_packing, op5_html_extraction, op6_toxicity, op7_suffix_array_dedup, op8_sentencepiece, op9_quality_classifier, op10_url_filters, op11_merkle_manifest, op12_order_minhash, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    """None for the others: learned models, byte-pair merges and greedy packing have no SQL; the shingle join and the
    repeated strings are too slow in SQL over whole tables; fingerprints hang on the engine's own hash. The tests hold them against plain Python (plain.py), against the
    libraries, or against labels that were held out."""
    return {"op3_nearest": NEAREST_SQL, "op10_url_filters": URL_SQL, "op11_merkle_manifest": merkle_sql(), "op13_filter_audit": AUDIT_SQL}
