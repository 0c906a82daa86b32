"""Wrapper induction: alignment against brute force, furniture without telling names, and pages that try to break it."""

import random
import time
from functools import cache

import pytest

from factloom.llm import html_extraction as H

PAGES = "page_id long, url string, html string"
STORY = "word of the story number {} goes on and on and says what nobody said before".format


def texts(spark, rows, parts=3):
    return {r.page_id: r.text for r in H.html_extraction(spark.createDataFrame(rows, PAGES).repartition(parts)).collect()}


def made_tree(r, depth=0):
    key = r.choice("ab")
    return f"<div class={key}>" + (r.choice(["", "x", "y"]) if r.random() < 0.5 else "") + "".join(made_tree(r, depth + 1) for _ in range(r.randint(0, 3) if depth < 3 else 0)) + "</div>"


def test_alignment_is_simple_tree_matching():
    """The size of the mapping is that of the textbook recursion."""

    def best(a, b):
        @cache
        def ordered(i, j):
            if not i or not j:
                return 0
            x, y = a.kids[i - 1], b.kids[j - 1]
            return max(ordered(i - 1, j), ordered(i, j - 1), ordered(i - 1, j - 1) + best(x, y) if x.key == y.key else 0)

        return 1 + (a.said == b.said != "") + ordered(len(a.kids), len(b.kids))

    r = random.Random(4)
    for _ in range(400):
        a, b = (H.finish(H.parse("".join(made_tree(r) for _ in range(r.randint(0, 4)))))[0] for _ in range(2))
        pairs = list(H.align(a, b))
        assert sum(1 + (x.said == y.said != "") for x, y in pairs) == best(a, b)
        assert all(x.key == y.key for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        up = {id(x): y for x, y in pairs}
        assert all(x.parent is None or up[id(x.parent)] is y.parent for x, y in pairs)


def test_furniture_without_telling_names_is_found_by_the_wrapper(spark):
    """Every page has furniture whose names say nothing, in blocks like those of its story; only the wrapper can tell."""
    rows, want = [], {}
    for i in range(40):
        story = [f"Headline {i}", "Background", *(STORY(f"{i} {k}") for k in range(1 + i % 4))]
        body = f"<h1>{story[0]}</h1><h2>{story[1]}</h2>" + "".join(f"<p>{x}</p>" for x in story[2:])
        more = "<div class=c9><a href=/a>Send</a> <a href=/b>Print</a></div>"
        rows.append((i, "http://a.org/x", f"<body><div class=c1>The Daily Paper, news since long ago</div><div class=c2>{body}{more}</div><div class=c3>Written by machines in a cellar</div></body>"))
        want[i] = "\n".join(story)
    assert texts(spark, rows) == want
    alone = [r.html for r in spark.createDataFrame(rows, PAGES).collect()]
    assert all(H.main_text(H.finish(H.parse(t)), None)[0] != want[i] for i, t in enumerate(alone))
    assert spark.createDataFrame(rows, PAGES).count() == H.html_extraction(spark.createDataFrame(rows, PAGES)).where("n_template >= 2").count()


def test_link_blocks_within_articles_go_headings_stay(spark):
    rows = [(i, "http://a.org/", f"<article><h2>Introduction</h2><p>{STORY(i)}</p><h2>Details</h2><p>{STORY(-i)}</p><p>See you</p><p><a href=x>Next story</a></p></article>") for i in range(1, 9)]
    assert texts(spark, rows) == {i: f"Introduction\n{STORY(i)}\nDetails\n{STORY(-i)}\nSee you" for i in range(1, 9)}


@pytest.mark.parametrize("holder", ["article", "div"])
def test_like_articles_keep_their_text(spark, holder):
    said = "\n".join(STORY(k) * 4 for k in range(5))
    rows = [(i, "http://a.org/", f"<body><nav>menu</nav><{holder}>" + "".join(f"<p>{x}</p>" for x in said.split("\n")) + f"</{holder}><ul class=menu><li>{i}</li></ul>") for i in range(3)]
    assert texts(spark, rows) == dict.fromkeys(range(3), said)


def test_attributes_are_read_one_by_one():
    for token, found in (
        ("<p title=\"a hidden gem\" class=x>", (" x", "", False)),
        ("<p data-class=ad id='b c'>", (" b c", "", False)),
        ("<p class = 'ad' hidden>", (" ad", "", True)),
        ("<p 'class=ad' role=Menu/>", ("", "menu/", False)),
        ("<p alt=\"x' class='ad\">", ("", "", False)),
    ):
        assert H.attributes(token) == found


def test_deep_and_wide_pages_end_soon(spark):
    deep = lambda n, t: "<div>" * n + t + "</p>" * n
    wide = lambda n, t: "".join(f"<p>{t} {i}</p><h2>{t}</h2>" for i in range(n))
    rows = [(i, "http://a.org/", f"<body>{deep(5000, 'down') if i % 2 else wide(5000, f'side {i}')}") for i in range(6)]
    begin = time.time()
    got = texts(spark, rows)
    assert got[1] == "down" and got[0] == "\n".join(f"side 0 {i}\nside 0" for i in range(5000))
    assert time.time() - begin < 60
    begin = time.time()
    a, b = (H.finish(H.parse(wide(1000, f"x{k}")))[0] for k in range(2))
    assert len(list(H.align(a, b))) == 2001 and time.time() - begin < 10


def test_wrappers_do_not_depend_on_the_deal():
    r = random.Random(6)
    pages = ["".join(made_tree(r) for _ in range(3)) + f"<p>{i % 4}" for i in range(30)]
    tables = [H.tabled(t, pages[:2]) for t in pages]
    whole = []
    for _ in range(5):
        some = tables[:]
        r.shuffle(some)
        while len(some) > 1:
            x, y = some.pop(r.randrange(len(some))), some.pop(r.randrange(len(some)))
            some.append(H.added(x, y))
        whole.append(H.wrapper(some[0], pages[:2]))
    assert all(w == whole[0] for w in whole)


def test_wrappers_too_many_to_send_are_dealt_beside_their_pages(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.org/x", f"<body><div class=a>Site {i % 7}</div><div class=b><p>{STORY(i)}</p></div><div class=c>End</div>") for i in range(70)] + [(99, None, "<p>no host"), (100, "http://h1.org", None)]
    small = texts(spark, rows)
    assert small[8] == STORY(8) and small[99] == "no host" and small[100] == ""
    monkeypatch.setattr(H, "BROADCAST", 0)
    assert texts(spark, rows) == small


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = [(1, "http://a.org/", "<p>same</p>")] * 5 + [(None, "http://a.org/", "<p>same</p>")]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "'x' as text", "2 as salt", "3 as blob")
    assert [r.text for r in H.html_extraction(frame).collect()] == ["same"] * 6
    assert H.html_extraction(frame.limit(0)).count() == 0


def test_quotes_count_where_a_value_begins():
    read = lambda page: H.main_text(H.finish(H.parse(page)), None)[0]
    assert read("<main><p>It is <a title=it's>ok</a> that's</p></main>") == "It is ok that's"
    assert read("<main><p class='a>b' title=\"x>y\">one</p><p 'odd name>two</p><p a=\"b>three</p></main>").startswith("one\ntwo")
    assert read("<main><p data-x = 'it > is' b=c'd e=\"'\">four</p><p title=>five</p></main>") == "four\nfive"
    assert read("<main><p>5 o'clock <b class=x'y>six</b> o'clock</p></main>") == "5 o'clock six o'clock"


def test_unclosed_elements_are_read_once():
    began = time.time()
    H.parse("<main>" + "<button>b <svg><select>" * 20_000)
    assert time.time() - began < 5
