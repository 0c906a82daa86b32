"""HTML extraction: wrappers induced by simple tree matching, and the main text of every page.

Pages of a host are aligned with ``REFERENCES`` pages of it, those of the smallest hashes, by simple tree matching: the
largest ordered mapping of two trees that keeps parents, where equal texts count as one more node. For each node of a
reference tree, the wrapper holds what the pages aligned with it say there: up to two different texts, up to three
different pages, and counts. All of these are sums or smallest values, so a wrapper doesn't depend on how pages are dealt
to tasks. A node is template if it says one text, on three different pages and on half of the host's pages or more;
the others are varying slots. Tasks fold their pages into small tables for each host and send those, not the pages;
a host's tables are merged in two steps, as a host may have a third of the pages. Wrappers are sent to all tasks if they
are small together (``BROADCAST``); beyond that, pages are dealt by host and a salt, the wrapper ahead of its pages.

A page's text is that within its articles (or its main element), without menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments. Two things tell them. Names do: elements, roles, and class or id
names, by the first word of a name, but within an article or main element by all its words, so that share-buttons go and a
share-price stays; formulas keep all their text. And the wrapper does: within an article, template blocks that are nothing but links
go. In pages without an article or main element, the region is the smallest element with nine tenths of the page's varying text;
template outside it goes, and so does template that is nothing but links within it; if that is the whole body,
template before the first and after the last varying slot goes too, save headings. Template in between is the
article's own, as headings like "Introduction" are. Where template would be more than half of what a host's pages say
and has blocks of ``PROSE`` characters or more, as with one article in print and mobile versions, none of it goes.

Edge cases: a null or empty page has an empty text; broken markup never fails (unclosed elements end with their parent,
unclosed comments and scripts with the page); trees of any depth are walked without recursion; alignment is exact for
up to ``CELLS`` pairs of children, beyond that equal subtrees that occur once are aligned first and what is left
between them in order; pages without a host are aligned with each other; a host with fewer than three different pages
has no template; repeated rows are extracted each and count as one page, save for the half; other columns don't matter;
an empty table gives no rows; white space is what Unicode says.
"""

from __future__ import annotations

import html
import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import small_batches, tidy, written
from factloom.llm.url_filters import parts

#: Pages of a host that the others are aligned with.
REFERENCES = 2
#: Total bytes of wrappers up to which they are sent to every task.
BROADCAST = 16_000_000
SALTS = 64
#: Different pages that a template text must be on.
SEEN_PAGES = 3
#: Characters of a block that is prose.
PROSE = 200
#: Pairs of children up to which alignment is exact, and pairs of nodes looked at for two pages.
CELLS, PAIRS = 4096, 50_000
#: Hosts and bytes of reference pages that a task holds before it sends them on.
HELD_HOSTS, HELD_BYTES = 2000, 64_000_000

#: A tag is a name and attributes; quotes count only where a value begins, so an apostrophe elsewhere swallows nothing.
VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++|)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*+(?:[\s/]++|=?[^\s=>/]++(?:{VALUE})?+|=)*+>?", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Attributes one by one.
ATTRIBUTE = re.compile(r"=?([^\s=>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Element names of HTML, and common class and id names of page furniture.
BLOCK = frozenset("html body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset blockquote pre figure figcaption address hr details summary dialog menu center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset("nav aside footer header form fieldset dialog menu head svg button select option label object audio video canvas map".split())
ENDS_PARAGRAPH = BLOCK - {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = frozenset("ul ol dl table thead tbody tfoot menu".split())
FURNITURE = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices popup modal overlay share sharing social comment comments respond disqus related newsletter subscribe subscription signup login toolbar pagination pager widget skip copyright".split())
# What may follow a furniture word in a name within an article, as in share-buttons or related-posts.
HOLDING = frozenset("area articles badge banner bar block box btn button buttons container form icon icons links panel placeholder posts row slot stories unit wrap wrapper zone".split())
COMPOUNDS = frozenset("comment-list comments-list menu-list nav-list social-list skip-to-content".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ARTICLE = ("article", "main")


class Node:
    """A block element: key (element, class and id names), children, and the texts between them.

    After ``finish``: its children, own text, signature and size of its subtree (texts count), and whether its own text is
    nothing but links.
    """

    __slots__ = ("dropped", "items", "key", "kids", "parent", "plain", "said", "sign", "size", "tag")

    def __init__(self, tag: str, key: str, parent: Node | None, dropped: bool):
        self.tag, self.key, self.parent, self.dropped = tag, key, parent, dropped
        self.items: list[Node | str] = []
        self.plain = False


def compound(name: str) -> bool:
    """Whether all of a name is furniture: a furniture word, then such words, holding words and numbers only."""
    first, *more = re.split(r"[-_]+", name)
    return name.replace("_", "-") in COMPOUNDS or first in FURNITURE and all(x in FURNITURE or x in HOLDING or not x.isalpha() for x in more)


def furniture(tag: str, names: str, role: str, hidden: bool, inside: bool) -> bool:
    """Whether an element is page furniture; an article's own header is not. Within an article, names count as a whole."""
    if tag in DROPPED and not (tag == "header" and inside) or hidden or role in ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    found = [n for n in names.lower().split() if (compound(n) if inside else re.split(r"[-_]", n)[0] in FURNITURE)]
    return any(not (inside and n.startswith("header")) for n in found) and not (tag == "article" and not any(n.startswith("comment") for n in found))


def attributes(token: str) -> tuple[str, str, bool]:
    """Class and id names, role, and whether hidden, of a start tag."""
    names, role, hidden = "", "", False
    for m in ATTRIBUTE.finditer(token, NAME.match(token).end()):
        name = (m[1] or "").lower()
        if name in ("class", "id"):
            names += " " + (m[2] or m[3] or m[4] or "")
        elif name == "role":
            role = (m[2] or m[3] or m[4] or "").strip().lower()
        elif name == "hidden":
            hidden = True
    return names, role, hidden


def parse(text: str) -> Node:
    """The tree of block elements; the text of inline elements belongs to the block around them."""
    root = Node("#", "#", None, False)
    at, words, pos = root, [], 0
    inside = 0  # articles that are open
    opened: Counter[str] = Counter()
    link = plain = False
    unclosed: set[str] = set()  # elements without a further end tag

    def flush() -> None:
        nonlocal plain
        if words:
            if said := " ".join(html.unescape("".join(words)).split()):
                at.items.append(said)
                at.plain = at.plain or plain
            words.clear()
        plain = False

    def close(to: Node) -> None:
        nonlocal at, inside
        flush()
        while at is not to:
            inside -= at.tag in ARTICLE
            opened[at.tag] -= 1
            at = at.parent

    for m in TOKEN.finditer(text):
        if m.start() < pos:
            continue  # within raw text
        if m.start() > pos:
            words.append(text[pos : m.start()])
            plain = plain or not link and not words[-1].isspace()
        token, pos = m.group(), m.end()
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                words.append(html.escape(token[9:].removesuffix("]]>")))
                plain = True
            continue
        tag = NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag in BLOCK:
                link = False
                if not opened[tag]:
                    flush()
                    continue
                node = at
                while node.tag != tag:
                    node = node.parent
                close(node.parent)
            elif tag == "a":
                link = False
            continue
        if tag in RAW or tag in DROPPED and tag not in BLOCK and tag not in ("label", "object"):
            if not token.endswith("/>"):
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(text, pos)
                if end is None:
                    unclosed.add(tag)
                pos = end.end() if end else len(text) if tag in RAW else pos
            words.append(" ")
            continue
        if tag == "br" or tag not in BLOCK:
            if tag in ("br", "img", "input"):
                words.append(" ")
            link = link or tag == "a"
            continue
        flush()
        link = False
        if tag in ENDS_PARAGRAPH and (at.tag == "p" or at.tag in HEADINGS and tag in HEADINGS):
            close(at.parent)
        if tag in SAME_LEVEL and any(opened[x] for x in SAME_LEVEL[tag]):
            node = at
            while node is not root and node.tag not in HOLDERS and node.tag not in SAME_LEVEL[tag]:
                node = node.parent
            if node.tag in SAME_LEVEL[tag]:
                close(node.parent)
                if tag == "tr":
                    while at.tag in ("tr", "td", "th"):
                        close(at.parent)
        names, role, hidden = attributes(token) if " " in token or "\n" in token or "\t" in token else ("", "", False)
        node = Node(tag, tag + re.sub(r"\d+", "0", names), at, furniture(tag, names, role, hidden, inside > 0))
        at.items.append(node)
        if tag not in VOID:
            at = node
            inside += tag in ARTICLE
            opened[tag] += 1
    if pos < len(text):
        words.append(text[pos:])
        plain = plain or not link
    close(root)
    return root


def finish(root: Node) -> list[Node]:
    """The tree's nodes, parents first; fills in what alignment needs."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        node.kids = [x for x in node.items if type(x) is Node]
        stack += reversed(node.kids)
    for node in reversed(out):
        node.said = "\n".join(x for x in node.items if type(x) is str)
        node.sign = hash((node.key, node.said, *(k.sign for k in node.kids)))
        node.size = 1 + bool(node.said) + sum(k.size for k in node.kids)
    return out


def own_score(a: Node, b: Node) -> int:
    """What two nodes of one key count by themselves."""
    return 1 + (a.said == b.said != "")


def gaps(a: list[Node], b: list[Node], room: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Children aligned at once, and the ranges left: equal subtrees at either end are aligned in some best mapping."""
    i, n, m = 0, len(a), len(b)
    while i < n and i < m and a[i].sign == b[i].sign:
        i += 1
    k = 0
    while n - k > i and m - k > i and a[n - k - 1].sign == b[m - k - 1].sign:
        k += 1
    sure = [(x, x) for x in range(i)] + [(n - x, m - x) for x in range(k, 0, -1)]
    if i == n - k or i == m - k:
        return sure, []
    if (n - k - i) * (m - k - i) <= min(CELLS, room):
        return sure, [(i, n - k, i, m - k)]
    left, right = (Counter(x.sign for x in c[i : len(c) - k]) for c in (a, b))
    place = {x.sign: j for j, x in enumerate(b[: m - k]) if j >= i and right[x.sign] == 1}
    tails: list[int] = []  # the longest rising run of places
    best: list[tuple[int, int, int]] = []
    held: list[int] = []
    for x in range(i, n - k):
        if left[a[x].sign] == 1 and (y := place.get(a[x].sign)) is not None:
            at = bisect_left(tails, y)
            best.append((x, y, held[at - 1] if at else -1))
            tails[at : at + 1] = [y]
            held[at : at + 1] = [len(best) - 1]
    chain, at = [], held[-1] if held else -1
    while at >= 0:
        chain.append(best[at][:2])
        at = best[at][2]
    ranges, x0, y0 = [], i, i
    for x, y in [*reversed(chain), (n - k, m - k)]:
        if x > x0 and y > y0:
            if (x - x0) * (y - y0) <= min(CELLS, room):
                ranges.append((x0, x, y0, y))
            else:  # in order, each with the next of its key
                where = defaultdict(list)
                for j in range(y0, y):
                    where[b[j].key].append(j)
                j = y0
                for v in range(x0, x):
                    own = where[a[v].key]
                    if (q := bisect_left(own, j)) < len(own):
                        sure.append((v, own[q]))
                        j = own[q] + 1
        x0, y0 = x + 1, y + 1
    return sure + chain, ranges


def align(a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
    """Simple tree matching: the pairs of the largest mapping of two finished trees whose roots are mapped."""
    plans: list[tuple[Node, Node, list, list]] = []
    number: dict[tuple[int, int], int] = {}
    stack, room = [(a, b)], PAIRS
    while stack:
        x, y = stack.pop()
        number[id(x), id(y)] = len(plans)
        sure, left = gaps(x.kids, y.kids, room)
        plans.append((x, y, sure, left))
        asked = [(x.kids[i], y.kids[j]) for i, j in sure]
        for i0, i1, j0, j1 in left:
            room -= (i1 - i0) * (j1 - j0)
            asked += [(u, v) for u in x.kids[i0:i1] for v in y.kids[j0:j1] if u.key == v.key]
        stack += [(u, v) for u, v in asked if u.sign != v.sign and u.kids and v.kids]
    scores = [0] * len(plans)

    def score(u: Node, v: Node) -> int:
        if u.sign == v.sign:
            return u.size
        return scores[number[id(u), id(v)]] if u.kids and v.kids else own_score(u, v)

    for at in range(len(plans) - 1, -1, -1):
        x, y, sure, left = plans[at]
        total = own_score(x, y) + sum(score(x.kids[i], y.kids[j]) for i, j in sure)
        for i0, i1, j0, j1 in left:
            rows = [[0] * (j1 - j0 + 1)]
            weights = {}
            for i in range(i0, i1):
                above, row, u = rows[-1], [0], x.kids[i]
                for j in range(j0, j1):
                    best = max(above[j - j0 + 1], row[-1])
                    if u.key == y.kids[j].key:
                        weights[i, j] = w = score(u, y.kids[j])
                        best = max(best, above[j - j0] + w)
                    row.append(best)
                rows.append(row)
            total += rows[-1][-1]
            i, j = i1, j1
            while i > i0 and j > j0:
                now = rows[i - i0][j - j0]
                if (w := weights.get((i - 1, j - 1))) and now == rows[i - i0 - 1][j - j0 - 1] + w:
                    i, j = i - 1, j - 1
                    sure.append((i, j))
                elif now == rows[i - i0 - 1][j - j0]:
                    i -= 1
                else:
                    j -= 1
        scores[at] = total
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        yield x, y
        if x.sign == y.sign:
            stack += zip(x.kids, y.kids, strict=True)
        elif x.kids and y.kids:
            stack += [(x.kids[i], y.kids[j]) for i, j in plans[number[id(x), id(y)]][2]]


def signature(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


@lru_cache(64)
def reference(text: str) -> tuple[Node, dict[int, int]]:
    """A reference page's tree, and the number of each of its nodes (by id)."""
    nodes = finish(parse(text))
    return nodes[0], {id(x): i for i, x in enumerate(nodes)}


#: Of a host: pages, their characters, and for each reference by node: texts, pages, count, characters.
Table = tuple[int, int, tuple[dict[int, tuple[tuple, tuple, int, int]], ...]]


def tabled(text: str, references: list[str]) -> Table:
    """A page's own table."""
    page, nodes = signature(text), finish(parse(text))
    rows = []
    for r in references:
        root, number = reference(r)
        rows.append({number[id(x)]: ((signature(y.said),), (page,), 1, len(y.said)) for x, y in align(root, nodes[0]) if y.said})
    return 1, sum(len(said) for _, said in blocks(nodes[0])), tuple(rows)


def added(a: Table, b: Table) -> Table:
    """Two tables of a host as one: sums, and the smallest of what is kept; in any order the same."""
    out = []
    for x, y in zip(a[2], b[2], strict=True):
        own = dict(x)
        for k, (texts, pages, n, size) in y.items():
            if (old := own.get(k)) is None:
                own[k] = (texts, pages, n, size)
            else:
                own[k] = (tuple(sorted({*old[0], *texts})[:2]), tuple(sorted({*old[1], *pages})[:SEEN_PAGES]), old[2] + n, old[3] + size)
        out.append(own)
    return a[0] + b[0], a[1] + b[1], tuple(out)


#: Of a host: whether template may go, and for each reference its html and the text of each template node.
Wrapper = tuple[bool, tuple[tuple[str, dict[int, int]], ...]]


def wrapper(table: Table, references: list[str]) -> Wrapper:
    """The template of a host."""
    found, whole = [], False
    for text, rows in zip(references, table[2], strict=True):
        root, number = reference(text)
        constant = {k: t[0] for k, (t, pages, n, _) in rows.items() if len(t) == 1 and len(pages) == SEEN_PAGES and 2 * n >= table[0]}
        found.append((text, constant))
        said = [rows[k][2:] for k in {number[id(x)] for x, _ in blocks(root)} & constant.keys()]
        whole |= 2 * sum(size for _, size in said) > table[1] and any(size >= PROSE * n for n, size in said)
    return not whole, tuple(found)


def constants(nodes: list[Node], own: Wrapper) -> set[int]:
    """Ids of the page's nodes that are template: aligned with a template node, and of its text."""
    out: set[int] = set()
    for text, constant in own[1]:
        if constant:
            root, number = reference(text)
            for x, y in align(root, nodes[0]):
                if y.said and (t := constant.get(number[id(x)])) is not None and signature(y.said) == t:
                    out.add(id(y))
    return out


def blocks(root: Node) -> Iterator[tuple[Node, str]]:
    """The texts below a node that names don't tell to be furniture, in order, each with the element it is in."""
    stack: list[tuple[Node, Node | str]] = [(root, x) for x in reversed(root.items)]
    while stack:
        owner, x = stack.pop()
        if type(x) is str:
            yield owner, x
        elif not x.dropped:
            stack += [(x, y) for y in reversed(x.items)]


def regions(root: Node) -> list[Node]:
    """The articles, or the main elements, that aren't within one another."""
    for tag in ARTICLE:
        out, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag == tag:
                out.append(node)
            else:
                stack += [x for x in reversed(node.kids) if not x.dropped]
        if out:
            return out
    return []


def main_text(nodes: list[Node], own: Wrapper | None) -> tuple[str, int]:
    """The blocks of the page's content, one to a line, and how many the wrapper left out."""
    root = nodes[0]
    found = regions(root)
    said = [x for region in found or [root] for x in blocks(region)]
    asked = own and own[0] and not (found and all(x.plain for x, _ in said))  # within articles, only blocks of links may go
    template = constants(nodes, own) if asked else set()
    if not template:
        return "\n".join(t for _, t in said), 0
    goes = {i for i, (x, _) in enumerate(said) if id(x) in template and not x.plain}
    if not found and (varying := [i for i, (x, _) in enumerate(said) if id(x) not in template]):
        size: Counter[int] = Counter()
        for i in varying:
            size[id(said[i][0])] += len(said[i][1])
        for node in reversed(nodes):
            if node.parent is not None:
                size[id(node.parent)] += size[id(node)]
        region, whole = root, size[id(root)]
        while (inner := next((x for x in region.kids if 10 * size[id(x)] >= 9 * whole), None)) is not None:
            region = inner
        within, stack = set(), [region]
        while stack:
            node = stack.pop()
            within.add(id(node))
            stack += node.kids
        edges = region.tag in ("#", "html", "body")
        for i, (x, _) in enumerate(said):
            if id(x) in template and (id(x) not in within or edges and x.tag not in HEADINGS and not varying[0] < i < varying[-1]):
                goes.add(i)
    if len(goes) == len(said):
        goes = set()
    return "\n".join(t for i, (_, t) in enumerate(said) if i not in goes), len(goes)


def references(pages: DataFrame) -> DataFrame:
    """host, pages (of the smallest hashes, by REFERENCES hashes) of pages (host, html): a task sends one page a host and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[int, str]] = {}
        size = 0

        def batch() -> pa.RecordBatch:
            columns = [[h for h, _ in held], [r for _, r in held], [x for x, _ in held.values()], [t for _, t in held.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["host", "r", "hash", "html"])

        for b in batches:
            for host, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if not text:
                    continue
                for r in range(REFERENCES):
                    x = xxhash.xxh3_64_intdigest(text, r) >> 1
                    old = held.get((host, r))
                    if old is None or (x, text) < old:
                        size += len(text) - (len(old[1]) if old else 0)
                        held[host, r] = (x, text)
            if len(held) > HELD_HOSTS or size > HELD_BYTES:
                yield batch()
                held, size = {}, 0
        if held:
            yield batch()

    made = pages.mapInArrow(tidy(run), "host string, r int, hash long, html string")
    best = made.groupBy("host", "r").agg(F.min(F.struct("hash", "html")).alias("x"))
    return best.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("r", F.col("x.html").alias("html")))).alias("x")).select("host", F.col("x.html").alias("references"))


def beside(pages: DataFrame, known: DataFrame, columns: str) -> DataFrame:
    """Rows of pages dealt by host and salt, after the row of known (host, blob) of their host; pages have no blob."""
    salts = known.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "blob")
    dealt = pages.withColumn("salt", F.pmod(F.xxhash64(*columns.split()), F.lit(SALTS)).cast("int"))
    both = salts.withColumn("first", F.lit(0)).unionByName(dealt.withColumn("first", F.lit(1)), allowMissingColumns=True)
    return both.repartition("host", "salt").sortWithinPartitions("host", "salt", "first").drop("salt", "first")


def attended(batches: Iterator[pa.RecordBatch], known: dict[str, bytes] | None) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Batches of pages with what is known of their hosts: from a dictionary, or from the rows ahead of theirs."""
    last: tuple[str | None, bytes | None] = (None, None)
    for b in batches:
        hosts = b.column("host").to_pylist()
        if known is not None:
            yield b, [known.get(h) for h in hosts]
            continue
        out, rows = [], []
        for i, (h, blob) in enumerate(zip(hosts, b.column("blob").to_pylist(), strict=True)):
            if blob is not None:
                last = (h, blob)
            else:
                rows.append(i)
                out.append(last[1] if last[0] == h else None)
        yield b.take(pa.array(rows, pa.int64())), out


def held_by_all(known: DataFrame) -> dict[str, bytes] | None:
    """known (host, blob) as a dictionary if it is small, else None."""
    size = known.agg(F.sum(F.length("blob"))).first()[0] or 0
    return {r.host: bytes(r.blob) for r in known.collect()} if size <= BROADCAST else None


@lru_cache(256)
def opened_blob(blob: bytes):
    return pickle.loads(blob)


PICKLED = "host string, blob binary"


def wrappers(pages: DataFrame, columns: str) -> DataFrame:
    """host, blob (a pickled wrapper) of pages (host, html and more columns)."""
    spark = pages.sparkSession

    def pickled(rows: dict[str, object]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([pickle.dumps(x) for x in rows.values()], pa.binary())], ["host", "blob"])

    def to_blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for host, found in zip(b.column("host").to_pylist(), b.column("references").to_pylist(), strict=True):
                yield pickled({host: found})

    picked = written(references(pages).mapInArrow(tidy(to_blob), PICKLED), "references")
    small = held_by_all(picked)
    sent = spark.sparkContext.broadcast(small)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Table] = {}
        for b, blobs in attended(batches, sent.value):
            for host, text, blob in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), blobs, strict=True):
                if text and blob is not None:
                    own = tabled(text, opened_blob(blob))
                    held[host] = added(held[host], own) if host in held else own
            if len(held) > HELD_HOSTS:
                yield pickled(held)
                held = {}
        if held:
            yield pickled(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, own = None, None
        for b in batches:
            for h, blob in zip(b.column("host").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if h != host and own is not None:
                    yield pickled({host: own})
                    own = None
                host, own = h, pickle.loads(blob) if own is None else added(own, pickle.loads(blob))
        if own is not None:
            yield pickled({host: own})

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for host, table, found in zip(*(b.column(c).to_pylist() for c in ("host", "table", "blob")), strict=True):
                yield pickled({host: wrapper(pickle.loads(table), pickle.loads(found))})

    tables = (beside(pages, picked, columns) if small is None else pages).mapInArrow(tidy(fold), PICKLED)
    salted = tables.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.repartition("host", "salt").sortWithinPartitions("host", "salt").select("host", "blob").mapInArrow(tidy(join), PICKLED)
    whole = some.repartition("host").sortWithinPartitions("host").mapInArrow(tidy(join), PICKLED)
    return whole.withColumnRenamed("blob", "table").join(picked, "host").select("host", "table", "blob").mapInArrow(tidy(close), PICKLED)


def html_extraction(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template (blocks that the wrapper left out) of every row of pages."""
    spark = pages.sparkSession
    small_batches(spark)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), parts(F.col(url_col))[0].alias("host"), F.col(html_col).cast("string").alias("html"))
    made = written(wrappers(own, "page_id url"), "wrappers")
    small = held_by_all(made)
    sent = spark.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in attended(batches, sent.value):
            out = []
            for text, blob in zip(b.column("html").to_pylist(), blobs, strict=True):
                out.append(main_text(finish(parse(text)), opened_blob(blob) if blob is not None else None) if text else ("", 0))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_template"],
            )

    rows = own if small is not None else beside(own, made, "page_id url")
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long, n_template long")
