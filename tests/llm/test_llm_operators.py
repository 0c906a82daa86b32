"""The other training-data operators: brute force, exact round trips, held-out accuracy, and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from factloom.llm import co_training, html_extraction, nearest, packing, pieces, quality_rules, queries, toxicity, url_filters

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_ROWS = [(1, None), (None, "some words here"), (3, ""), (4, " \n\t "), (5, "word " * 30_000), (6, "same"), (6, "same"), (7, "é½日本 \x1c\x00 ok")]


def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, 1) for i, t in ODD_ROWS], "doc_id long, text string, lang string, source string, n_chars long, score int")


def labels_of(spark, n=60):
    return spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(n)], "doc_id long, quality int, toxic int")


def test_text_stats_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["a ", "b ", "c\n", "#", "é ", "\t", "dd "]) for _ in range(r.randint(0, 60)))
        words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
        seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        cover = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.strip(" \t")]
        want = (len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(cover))
        assert quality_rules.text_stats(text.encode())[0] == want


def test_trees_are_monotonic_and_fit():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.2)).astype(float)
    trees = quality_rules.fit_trees(x, y, [-1, 1, 0])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.98
    for j, sign in ((0, -1), (1, 1)):
        probe = np.repeat(r.random((50, 3)), 40, 0)
        probe[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(trees.score(probe).reshape(50, 40), axis=1) * sign
        assert steps.min() >= -1e-12


def test_quality_rules_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    trees = quality_rules.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality_rules.judge(docs, trees).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").selectExpr("avg(int(kept = (quality = 1)))").first()[0]
    assert got > 0.97


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").selectExpr("sum(predicted * toxic) hit", "sum(predicted) said", "sum(toxic) there").first()
    assert rows.hit / rows.said > 0.85 and rows.hit / rows.there > 0.85


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 5.0})
    assert g.score("you idiot.") > 0.9 and g.score("idiots everywhere") > 0.9
    assert g.score("he said idiot") < g.score("an idiot") and g.score("never an idiot") < g.score("an idiot")
    assert g.score("i will kill you") > 0.7 and g.score("kill the lights") == pytest.approx(g.base) == g.score("")


def test_ids_match_the_tokenizer():
    ids, r = packing.Ids(BPE), random.Random(3)
    texts = ["".join(r.choice(["ab", " ", "\n", ",", ".", "'s", "é", "½", "日", "　", "\x1c", "<|endoftext|>", "12"]) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for text, got in zip(texts, ids(texts), strict=True):
        assert got.tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_plan_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(200):
        cap = r.choice([10, 16, 50])
        sizes = [r.randint(1, cap) for _ in range(r.randint(0, 150))]
        fill, seen = Counter(), Counter()
        for size, _, n, first, per, offset in packing.plan(Counter(sizes), cap):
            for k in range(n):
                assert fill[first + k // per] == offset + k % per * size
                fill[first + k // per] += size
                seen[size] += 1
        rooms = []
        for size in sorted(sizes, reverse=True):
            fit = [x for x in rooms if x >= size]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else cap) - size)
        assert seen == Counter(sizes) and sorted(cap - x for x in fill.values()) == sorted(rooms)


def test_packing_is_whole(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    rows = packing.best_fit_packing(docs, BPE).toPandas().sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all() and rows.groupby("sequence_id").length.sum().max() <= 1024
    encode = packing.Ids(BPE).tokenizer.encode
    assert rows.length.sum() == sum(1 + len(encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())


def test_pieces_match_the_library():
    model, r = pieces.Model(PIECES), random.Random(2)
    texts = ["".join(r.choice("ab  \n\té日½’theing▁12") for _ in range(r.randint(0, 25))) for _ in range(3000)]
    for text, got in zip(texts, model.encode(texts), strict=True):
        assert got.tolist() == model.processor.encode(text) and model.decode(got.tolist()) == model.processor.decode(got.tolist())


def test_pieces_round_trip(spark):
    assert pieces.round_trips(spark.read.parquet(f"{SMALL}/documents.parquet"), PIECES).where("not same").count() == 0
    ids = pieces.encoded(odd(spark), PIECES)
    assert {r.text for r in pieces.decoded(ids, PIECES).collect()} >= {"some words here", ""}


def test_nearest_against_brute_force(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    more = spark.createDataFrame([(10_001, None), (10_002, [0.0] * 64), (10_003, [float("nan")] * 64), (10_004, [1.0, 2.0]), (10_100, [1.0, 2.5]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = vectors.union(more)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest.nearest(rows, rows.where("vec_id % 100 = 0"), chunk=3).collect()}
    table = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    for query in [i for i in table if i % 100 == 0]:
        want = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(table[query], v, strict=True))), i) for i, v in table.items() if i != query)[:10]
        assert [got[query, k + 1][0] for k in range(10)] == [i for _, i in want]
    assert got[10_100, 1] == (10_004, 0.5) and (10_100, 2) not in got


PAGE = "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>cookies</div><article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>\n text<p>Two<br><div class=ad>buy</div><section class='comments'><p>a reader</p></section><form>x</form></article><aside>side</aside><footer>&copy;</footer>"


def test_html_main_text(spark):
    rows = [(1, "http://a.org/x", PAGE), (2, None, None), (3, "http://a.org/y", ""), (4, "no url", "<p>only <i>this"), (5, "http://b.org/", "<body><main>in main<nav>no</nav></main><p>out"), (6, "x", "<!-- never closed <p>gone")]
    got = {r.page_id: r.text for r in html_extraction.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Title & more\nOne bold text\nTwo", 2: "", 3: "", 4: "only this", 5: "in main", 6: ""}


def test_wrapper_drops_what_a_host_repeats(spark):
    rows = [(i, "http://a.org/x", f"<body><div class=top>Welcome to us</div><div class=text>Story {i}</div><div class=end>All rights</div>") for i in range(6)]
    got = html_extraction.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert sorted(r.text for r in got) == [f"Story {i}" for i in range(6)]


def test_wrapper_keeps_a_slot_filled_on_one_page(spark):
    filled = "<p>a</p><article>Bare text<br>with a break</article><div class=end>All rights</div>"
    rows = [(i, "http://a.org/x", f"<body><article><p>Story {i}</p></article><div class=end>All rights</div>") for i in range(5)] + [(9, "http://a.org/y", f"<body>{filled}")]
    got = {r.page_id: r.text for r in html_extraction.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {**{i: f"Story {i}" for i in range(5)}, 9: "Bare text with a break"}


def test_only_the_wrappers_own_text_is_template():
    pages = [f"<div>Same</div><!--{i}-->" for i in range(4)]
    table = html_extraction.tabled(pages[0], pages[:2])
    for text in pages[1:]:
        table = html_extraction.added(table, html_extraction.tabled(text, pages[:2]))
    wrapper = html_extraction.wrapper(table, pages[:2])
    for text, n in ((pages[0], 1), ("<div>Other</div>", 0)):
        assert len(html_extraction.constants(html_extraction.finish(html_extraction.parse(text)), wrapper)) == n


def test_articles_lose_whole_furniture_names_only():
    kept = ["<p class=share-price>Up 3 %", "<section class=related-work>Others found", "<div class=notice-period>Two months", "<p id=skip_list>Levels", "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold"]
    gone = ["<div class=share-buttons>Share", "<div class='box related'>More", "<div id=ad_12>Buy", "<div class=newsletter-signup-form>Sign up", "<ul class=social__links>Follow"]
    close = lambda x: x + "</" + re.match(r"<(\w+)", x)[1] + ">"
    page = "<body><article>" + "".join(map(close, kept + gone)) + "</article>"
    assert html_extraction.main_text(html_extraction.finish(html_extraction.parse(page)), None)[0] == "Up 3 %\nOthers found\nTwo months\nLevels\nLet x=1 hold"


def test_html_table(spark):
    """The pages' articles, cut out by a plainer path that knows these pages' one form."""
    import html
    import re

    got = {r.page_id: r.text for r in html_extraction.html_extraction(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()}
    for r in pq.read_table(f"{SMALL}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/", "http://x.com", "http://x.com/", "ftp://a.net/es/z", "http://a.net/de/", "nothing", None, "http://notexample.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filters(pages, none, queries.URL_RULES).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[1][2:] == ("example.com/en/", "block")
    assert got[2] == ("x.com", "", None, "allow") and got[3][2:] == ("com/", "allow") and got[4][2:] == ("net/es/", "block")
    assert got[5][2:] == (None, "allow") and got[6] == got[7] == ("", "", None, "allow") and got[8][2] == "com/"


def test_url_reputation_blocks_bad_hosts(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 4 == 0 else 'good' + str(i % 9)}.org/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "page_id long, bad long")
    got = url_filters.url_filters(pages, labels, []).groupBy("host", "verdict").count().collect()
    assert {(r.host, r.verdict) for r in got if r.verdict == "block"} == {("bad.org", "block")}


def test_unlabelled_hosts_have_the_bound_of_their_prior(spark):
    hosts = ["a.evil.com"] * 3000 + [f"h{i % 30}.good{i % 10}.com" for i in range(3000)] + ["b.evil.com", "new.good1.com", "x.new.com", "x.new.net", "a.evil.com"]
    pages = spark.createDataFrame([(i, f"http://{h}/{i}") for i, h in enumerate(hosts)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(6000)], "page_id long, bad long")
    got = {r.host: r for r in url_filters.url_filters(pages, labels, []).where("page_id >= 6000").collect()}
    assert {h for h, r in got.items() if r.verdict == "block"} == {"a.evil.com", "b.evil.com"}
    assert got["a.evil.com"].bound > got["b.evil.com"].bound > 0.2
    assert got["new.good1.com"].bound is not None and got["x.new.com"].bound is not None and got["x.new.net"].bound is not None
    none = url_filters.url_filters(pages, labels.limit(0), [])
    assert none.where("verdict = 'block' or bound is not null").count() == 0


def test_nested_priors_add_their_spread():
    r, mean = np.random.default_rng(1), 0.3
    suffix = r.beta(9 * mean, 9 * (1 - mean), 400_000)
    host = r.beta(5 * suffix, 5 * (1 - suffix))
    assert mean * (1 - mean) / (url_filters.unseen(5, 9) + 1) == pytest.approx(host.var(), rel=0.02)


def test_co_training_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = co_training.quality_classifier(docs, labels).join(labels, "doc_id").where("held_out").selectExpr("avg(int(predicted = quality))").first()[0]
    assert got > 0.9


@pytest.mark.parametrize("operator", ["quality", "toxic", "classifier", "clean", "civil"])
def test_odd_rows_and_empty_tables(spark, operator):
    run = {"quality": quality_rules.quality_rules, "toxic": toxicity.toxicity, "classifier": co_training.quality_classifier, "clean": quality_rules.keep_clean, "civil": toxicity.drop_toxic}[operator]
    docs, labels = odd(spark), labels_of(spark)
    out = run(docs, labels)
    assert out.count() == len(ODD_ROWS) if operator not in ("clean", "civil") else out.columns == docs.columns
    assert run(docs.limit(0), labels.limit(0)).count() == 0
