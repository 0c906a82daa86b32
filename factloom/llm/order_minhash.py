"""Order MinHash: fingerprints of texts whose likeness falls with edit distance, not only with what the texts share.

A text is read as tokens (runs without white space; a single character where a script sets no spaces), a k-mer is a token
with the next K - 1, as far as there are any, and equal k-mers of a text are numbered by their place. Each (k-mer, number)
gets one hash on a ring. A sketch position is a point of the ring: the order clockwise from there is a random order of the
k-mers, of which the TAKEN smallest are selected. Their k-mers, put back in text order, are hashed as a tuple to one entry of the fingerprint.
Two fingerprints are alike in the share of equal entries.

All of it is built-in functions over arrays of longs within a row, hash and place packed in one, so that sorting is
sorting of longs; every step is linear or a sort, and long texts are cut in blocks, at white space
if they have any, before they are matched, so memory is a few times a text's own bytes.

Edge cases: a null text is empty. A text without tokens has the empty fingerprint, like (1) to empty ones alone, unlike
(0) to others. Rows of one id are ordered by the digest of their text. Equal rows are one while texts are moved, and then
as many again: all but the last are followed by a copy of themselves. A null id comes before all others. The only row of a
table follows itself. An empty table gives no rows. Other columns of docs aren't read, whatever they are named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import written
from factloom.llm.radix import ranked

#: Tokens of a k-mer, k-mers of a tuple, entries of a fingerprint (a power of two) and its bits, bits of an entry.
K, TAKEN, ENTRIES, POINTS, ENTRY = 3, 2, 64, 6, 15
#: A packed long: a hash above PLACE bits of a place. Spark's texts can't have 2^30 - 1 tokens.
PLACE = 30
LAST = (1 << PLACE) - 1  # the place that marks a point of the ring
#: Characters matched at once, in longer texts.
BLOCK = 1 << 16
BLOCKS = rf"(?s).{{0,{BLOCK - 1}}}\s|.{{1,{BLOCK}}}"
#: A token: a run of characters below U+0E00, or one above, where many scripts set no spaces.
TOKEN = r"[!-෿]+|[^\s!-෿]"


def low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def at(array: str, index: Column) -> Column:
    """An element that is there; the plan is told so, as arrays without nulls sort as plain longs."""
    return F.coalesce(F.get(array, index), F.lit(0).cast("long"))


def shifted(bits: int) -> Callable[[Column, Column], Column]:
    """Hashes put together so that their order counts."""
    return lambda a, b: a.bitwiseXOR(F.shiftrightunsigned(b, bits))


def packed(value: Column, place: Column) -> Column:
    """The upper bits of the hash go; the sign stays, as any bit."""
    return F.coalesce(F.shiftleft(value, PLACE).bitwiseOR(place.cast("long")), F.lit(0).cast("long"))


def fingerprinted(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`, the entries of a text's fingerprint: an array of ENTRIES shorts, or none for a text without tokens.

    Each step is a column that the next reads more than once, so the optimizer keeps the steps apart.
    """
    kept = [F.col(c) for c in df.columns]
    step = lambda frame, **new: frame.select(*kept, *(c.alias(n) for n, c in new.items()))
    none, hashes = F.array().cast("array<int>"), F.array().cast("array<long>")
    blocks = F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(BLOCKS), F.lit(0)))
    tokens = F.flatten(F.transform(blocks, lambda b: F.transform(F.regexp_extract_all(b, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))))
    frame = step(df, _t=F.concat(tokens, F.array(*[F.lit(0).cast("long")] * (K - 1))))  # zeros: no token
    n = F.size("_t") - (K - 1)
    mers = F.slice("_t", F.lit(1), n)
    for j in range(1, K):
        mers = F.zip_with(mers, F.slice("_t", F.lit(j + 1), n), shifted(7 * j))
    frame = step(frame, _k=mers)
    frame = step(frame, _k=F.col("_k"), _p=F.sort_array(F.transform("_k", packed)), _u=F.size(F.array_distinct("_k")))  # by k-mer, equal ones by place
    mer = lambda j: F.shiftright(F.get("_p", j), PLACE)
    again = F.filter(F.sequence(F.lit(1), F.size("_p") - 1), lambda j: mer(j) == mer(j - 1))
    frame = step(frame, _k=F.col("_k"), _p=F.col("_p"), _e=F.when(F.col("_u") < F.size("_p"), again).otherwise(none))
    # those of one k-mer stand next to each other: a run of them begins where the one before isn't the last's neighbour
    runs = F.filter(F.sequence(F.lit(0), F.size("_e") - 1), lambda i: (i == 0) | (F.get("_e", i) != F.get("_e", i - 1) + 1))
    frame = step(frame, _k=F.col("_k"), _p=F.col("_p"), _e=F.col("_e"), _r=F.when(F.size("_e") > 0, runs).otherwise(none))
    numbers = F.flatten(F.transform("_r", lambda s, i: F.sequence(F.lit(1), F.coalesce(F.get("_r", i + 1), F.size("_e")) - s)))
    frame = step(frame, _k=F.col("_k"), _p=F.col("_p"), _e=F.col("_e"), _n=numbers)
    # the first of equal k-mers has the k-mer's own hash, the others one of k-mer and number
    same = F.transform("_e", lambda j: at("_p", j))
    other = F.transform("_e", lambda j, i: packed(F.xxhash64(mer(j), F.get("_n", i)), low(F.get("_p", j), PLACE)))
    ring = F.when(F.size("_n") > 0, F.sort_array(F.concat(F.array_except("_p", same), other))).otherwise(F.col("_p"))
    frame = step(frame, _k=F.col("_k"), _s=ring)
    points = F.array(*(F.lit(((i << (64 - POINTS)) - (1 << 63)) | LAST).cast("long") for i in range(ENTRIES)))
    frame = step(frame, _k=F.col("_k"), _s=F.concat("_s", F.slice("_s", 1, TAKEN)), _m=F.sort_array(F.concat("_s", points)))  # past its end the ring begins anew
    found = F.filter(F.sequence(F.lit(0), F.size("_m") - 1), lambda j: F.get("_m", j).bitwiseAND(F.lit(LAST)) == LAST)
    frame = step(frame, _k=F.col("_k"), _s=F.col("_s"), _b=F.when(F.size("_s") > 0, found).otherwise(none))
    # the i-th point has j - i k-mers before it; a text of one k-mer has the same again and again
    place = lambda k: F.transform("_b", lambda j, i: low(F.coalesce(F.get("_s", j - i + k), F.get("_s", F.lit(0))), PLACE))
    frame = step(frame, _k=F.col("_k"), _a=place(0), _c=place(1))
    first = lambda a, i: F.least(a, F.get("_c", i)).cast("int")
    last = lambda a, i: F.greatest(a, F.get("_c", i)).cast("int")
    entries = F.transform("_a", lambda a, i: low(F.xxhash64(F.get("_k", first(a, i)), F.get("_k", last(a, i))), ENTRY))
    return step(frame, **{name: entries.cast("array<smallint>")})


def shown(entries: Column) -> Column:
    """A fingerprint as text: its entries."""
    return F.array_join(entries.cast("array<string>"), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries; texts without tokens are like each other."""
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(ENTRIES - 1)), lambda i: F.get(a, i) == F.get(b, i)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(equal / ENTRIES)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and fingerprint."""
    return fingerprinted(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_text", "entries").select("doc_id", shown(F.col("entries")).alias("fingerprint"))


def next_of(rows: DataFrame) -> DataFrame:
    """Pairs (of, to: id and digest of texts, times): each row and the one after it, and equal rows with themselves."""
    placed = written(ranked(rows.withColumn("_group", F.lit("")), "_group", "doc_id", "sha", "copies"), "ranks")
    after = placed.select(F.col("rank").alias("_at"), F.col("doc_id").alias("to_id"), F.col("sha").alias("to_sha"), F.col("entries").alias("to_entries"))
    own = placed.withColumn("_at", F.pmod(F.col("rank") + F.col("copies"), F.col("total"))).select("doc_id", "sha", "half", "copies", "entries", "_at")
    pair = lambda df, to_id, to_sha, times, near: df.select("doc_id", "sha", "half", F.col(to_id).alias("to_id"), F.col(to_sha).alias("to_sha"), times.alias("times"), near.alias("near_next"))
    last = pair(own.join(after, "_at"), "to_id", "to_sha", F.lit(1).cast("long"), likeness(F.col("entries"), F.col("to_entries")))
    return written(last.union(pair(placed.where("copies > 1"), "doc_id", "sha", F.col("copies") - 1, F.lit(1.0))), "pairs")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Fingerprints are made where rows are read; what is ranked and paired are ids, digests and entries. Texts go through
    one shuffle by id and digest, and what each lends to the text before it through another.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(whole, 256)).alias("digest")]
    read = docs.select(*keys, F.length(whole).alias("n_chars"), whole.alias("_text"))
    entries = fingerprinted(read, "_text", "entries").drop("_text")
    firsts = [F.first(c).alias(c) for c in ("n_chars", "entries")]
    rows = written(entries.groupBy("doc_id", "digest").agg(*firsts, F.count("*").alias("copies")), "fingerprints")
    pairs = next_of(rows.select("doc_id", F.hex("digest").alias("sha"), F.shiftright("n_chars", 1).alias("half"), "copies", "entries"))
    # keys without nulls, so that grouped texts stay where they are for both joins
    key = lambda i, digest: F.struct(i.isNotNull().alias("named"), F.coalesce(i, F.lit(0).cast("long")).alias("id"), digest.alias("digest")).alias("_key")
    texts = read.select(key(F.col("doc_id"), F.col("digest")), "_text").groupBy("_key").agg(F.first("_text").alias("_text"))
    wanted = pairs.select(key(F.col("doc_id"), F.unhex("sha")).alias("_of"), "half", key(F.col("to_id"), F.unhex("to_sha")), "times", "near_next")
    lent = wanted.join(texts, "_key").select(F.col("_of").alias("_key"), F.substring("_text", F.lit(1), F.col("half")).alias("lent"), "times", "near_next")
    met = texts.join(lent, "_key").join(rows.select(key(F.col("doc_id"), F.col("digest")), "n_chars", "entries"), "_key")
    kept = F.substring("_text", F.lit(1), F.col("n_chars") - F.shiftright("n_chars", 1))
    edited = met.select(F.when(F.col("_key.named"), F.col("_key.id")).alias("doc_id"), F.col("n_chars").cast("long"), "entries", "times", "near_next", F.concat(kept, F.col("lent")).alias("_text"))
    out = fingerprinted(edited.withColumn("edited_sha256", F.sha2("_text", 256)), "_text", "edited").drop("_text")
    out = out.withColumn("fingerprint", shown(F.col("entries"))).withColumn("edited_fingerprint", shown(F.col("edited"))).withColumn("near_edited", likeness(F.col("entries"), F.col("edited")))
    many = out.withColumn("_span", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("times") - 1, 16)))).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1 << 16).cast("long"), F.col("times") - F.shiftleft("_span", 16)))))
    return many.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
