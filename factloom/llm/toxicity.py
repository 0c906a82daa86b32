"""Toxicity: a weighted finite-state pattern grammar over clauses.

A text is cut into clauses at sentence marks and line ends. The lexicon, a trie of insult stems and lists of marker
words, reads a clause's words as a string of symbols: INSULT, THREAT, FUTURE, TARGET, NOT, SAYS, or WORD, with OPEN and
CLOSE for quotes that touch a word. Transducers, each a table of arcs, rewrite that string and are composed into one:

* negation: an INSULT within three words after NOT becomes DENIED.
* reported speech: an INSULT or DENIED after SAYS, or between OPEN and CLOSE, becomes QUOTED. That a CLOSE follows is
  guessed, and a wrong guess has no arc to go on.
* target: an INSULT becomes AIMED if the clause has a TARGET anywhere, also later; that is guessed at the start of the
  clause, and only right guesses end in a final state.
* threat, beside those: FUTURE, THREAT and TARGET in this order, with anything between them, make the clause THREATENED.

Weights are evidence by kind of match: an arc that ends a match adds the insult's weight to its kind, and a path's
weight is the sum. One pass over a clause follows all live states; exactly one path is accepted. How much a plain, aimed,
denied or quoted match counts is itself fitted on the labelled rows, from a prior in which denial and quotation weaken; so a corpus
whose labels ignore them wins over the prior. The document's score joins its clauses as independent causes (noisy or).

Insults are learned as stems, word prefixes that mark labelled toxic texts, from a sample bounded in rows
(``TRAIN_ROWS``) and bytes (``TRAIN_BYTES``), in the order of a hash of the id. A stem that a few toxic texts share needs
three families of them, however large the sample is.

Edge cases: a null or empty text has no clause and scores the base rate of texts without a match; without labelled
rows, or with labels of one class only, there are no insults, and only threats score; a null id is not held out
and never trains; repeated rows score alike, and of rows that share an id one trains; an empty table gives no rows;
a stem's word is read as INSULT even if it is a marker word as well, except that threats read markers only.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import in_fold, small_batches, tidy, written
from factloom.llm.quality_rules import label_sample, one_an_id, texts_of

#: Bounds on the labelled rows that the grammar is fitted on, and on the bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 12_000, 128_000_000
TOXIC_AT = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n\r]+")
QUOTES = "\"'«»“”„‘’"
SHORT, SEED, LONG = 3, 8, 12

# Marker words of four languages, by the symbol that they are read as.
MARKERS = {
    "TARGET": frozenset("you your yours yourself he she him her his they them their du dich dir dein deine ihr euch er sie ihn ihm tu te toi ton ta tes vous votre vos il elle ils elles lui tú ti usted ustedes vosotros él ella ellos ellas".split()),
    "NOT": frozenset("not no never nicht kein keine keinen nie niemals pas jamais aucun aucune non nunca jamás ningún ninguna tampoco".split()),
    "SAYS": frozenset("said says say called calls quoted quote wrote sagte sagt nannte schrieb zitierte dit disait appelé écrit cité dijo dice llamó escribió citó".split()),
    "FUTURE": frozenset("will gonna shall going werde werden vais va allons voy vamos".split()),
    "THREAT": frozenset("kill hurt destroy beat murder burn töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()),
}
THREAT = MARKERS["THREAT"]
INPUT = ("INSULT", "WORD", "OPEN", "CLOSE", *MARKERS)
WORDS = ("INSULT", "WORD", *MARKERS)

#: What each kind of match counts before it is fitted.
KINDS = ("plain", "aimed", "denied", "quoted")
PRIOR = np.array([1.0, 1.2, 0.4, 0.3])
#: The kind whose evidence an output symbol adds to; the last one is a threat, which counts once.
EVIDENCE = {"INSULT": 0, "AIMED": 1, "DENIED": 2, "QUOTED": 3, "THREATENED": 4}


@dataclass(frozen=True)
class Transducer:
    """Arcs by state and symbol read: (next state, symbol written). Symbols without any arc are written as they are."""

    arcs: dict[tuple[str, str], tuple[tuple[str, str], ...]]
    starts: tuple[str, ...]
    finals: frozenset[str]

    def step(self, state: str, symbol: str) -> tuple[tuple[str, str], ...]:
        return self.arcs.get((state, symbol), ((state, symbol),))


def negation(reach: int = 3) -> Transducer:
    """States: words that the last NOT still reaches."""
    arcs = {}
    for k in range(reach + 1):
        for x in WORDS:
            arcs[str(k), x] = ((str(max(0, k - 1)), "DENIED" if x == "INSULT" and k else x),)
        arcs[str(k), "NOT"] = ((str(reach), "NOT"),)
    return Transducer(arcs, ("0",), frozenset(map(str, range(reach + 1))))


def reported_speech() -> Transducer:
    """States: before or after SAYS; then nothing, after OPEN, and after a match for which a CLOSE is due or must not come."""
    arcs: dict[tuple[str, str], tuple[tuple[str, str], ...]] = {}
    for said in ("quiet", "said"):
        for phase in ("", " open", " due", " bare"):
            at = said + phase
            for x in (*WORDS, "DENIED", "OPEN", "CLOSE"):
                if phase == " due":
                    arcs[at, x] = ((said, x),) if x == "CLOSE" else ()
                elif phase == " bare" and x == "CLOSE":
                    arcs[at, x] = ()
                elif x == "OPEN":
                    arcs[at, x] = ((said + " open", x),)
                elif x == "SAYS":
                    arcs[at, x] = (("said", x),)
                elif x in ("INSULT", "DENIED"):
                    if said == "said":
                        arcs[at, x] = ((said, "QUOTED"),)
                    elif phase == " open":
                        arcs[at, x] = ((said + " due", "QUOTED"), (said + " bare", x))
                    else:
                        arcs[at, x] = ((said, x),)
                else:
                    arcs[at, x] = ((said, x),)
    return Transducer(arcs, ("quiet",), frozenset(x + y for x in ("quiet", "said") for y in ("", " open", " bare")))


def target() -> Transducer:
    """States: guessed that there is no TARGET, that one comes, and one that came."""
    arcs = {("none", "TARGET"): (), ("comes", "TARGET"): (("came", "TARGET"),)}
    arcs |= {(state, "INSULT"): ((state, "AIMED"),) for state in ("comes", "came")}
    return Transducer(arcs, ("none", "comes"), frozenset(("none", "came")))


def threat() -> Transducer:
    """States: how much of FUTURE, THREAT, TARGET was read."""
    arcs = {("none", "FUTURE"): (("future", "FUTURE"),), ("future", "THREAT"): (("threat", "THREAT"),), ("threat", "TARGET"): (("done", "THREATENED"),)}
    return Transducer(arcs, ("none",), frozenset(("none", "future", "threat", "done")))


def composed(a: Transducer, b: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """a, then b on what a writes; only states that can be reached. symbols: those that a reads."""
    name = lambda x, y: f"{x}|{y}"
    todo = [(x, y) for x in a.starts for y in b.starts]
    starts, arcs, seen = tuple(name(*z) for z in todo), {}, set(todo)
    while todo:
        x, y = todo.pop()
        for symbol in symbols:
            out = []
            for to_x, middle in a.step(x, symbol):
                for to_y, written in b.step(y, middle):
                    out.append((name(to_x, to_y), written))
                    if (to_x, to_y) not in seen:
                        seen.add((to_x, to_y))
                        todo.append((to_x, to_y))
            arcs[name(x, y), symbol] = tuple(out)
    return Transducer(arcs, starts, frozenset(name(x, y) for x, y in seen if x in a.finals and y in b.finals))


@cache
def cascades() -> tuple[Transducer, Transducer]:
    """What reads insults, and what reads threats."""
    return composed(composed(negation(), reported_speech(), INPUT), target(), INPUT), threat()


def evidence(machine: Transducer, clause: list[tuple[str, float]]) -> np.ndarray | None:
    """Weight of the accepted path over a clause of (symbol, weight): evidence by kind; None if there is no such path."""
    alive = {state: np.zeros(5) for state in machine.starts}
    for symbol, weight in clause:
        then: dict[str, np.ndarray] = {}
        for state, sums in alive.items():
            for to, written in machine.step(state, symbol):
                then[to] = sums
                if (k := EVIDENCE.get(written)) is not None:
                    then[to] = sums.copy()
                    then[to][k] += weight
        alive = then
    return next((sums for state, sums in alive.items() if state in machine.finals), None)


@dataclass(frozen=True)
class Grammar:
    stems: dict[str, float] = field(default_factory=dict)
    counts: tuple[float, ...] = tuple(PRIOR)
    base: float = 0.02
    markers: dict[str, frozenset[str]] = field(default_factory=lambda: MARKERS)

    def automaton(self) -> ahocorasick.Automaton:
        """Finds the texts that have any stem or threat; the cascade runs on those alone."""
        a = ahocorasick.Automaton()
        for w in sorted(set(self.stems) | self.markers["THREAT"]):
            a.add_word(w, w)
        a.make_automaton()
        return a

    def insult(self, word: str) -> float:
        """Weight at which the trie of stems accepts a word: that of the longest stem it begins with, else 0."""
        for k in range(min(len(word), LONG), SHORT - 1, -1):
            if (w := self.stems.get(word[:k])) is not None:
                return w
        return 0.0

    def read(self, clause: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """The clause as the lexicon reads it, for insults and for threats: symbols with weights."""
        kind = {x: symbol for symbol, words in self.markers.items() for x in words} if self.markers is not MARKERS else KIND_OF
        insults, marks = [], []
        for m in LETTERS.finditer(clause):
            word, a, b = m.group(), m.start(), m.end()
            if a and clause[a - 1] in QUOTES:
                insults.append(("OPEN", 0.0))
            mark = kind.get(word, "WORD")
            w = self.insult(word)
            insults.append(("INSULT", w) if w > 0 else (mark, 0.0))
            marks.append((mark, 1.0))
            if clause[b : b + 1] and clause[b] in QUOTES:
                insults.append(("CLOSE", 0.0))
        return insults, marks

    def matches(self, text: str) -> Iterator[tuple[np.ndarray, bool]]:
        """For each clause with a match: the weights by kind, and whether it is a threat."""
        abuse, menace = cascades()
        for clause in CLAUSE.split(text.lower()):
            insults, marks = self.read(clause)
            hit = any(x == "INSULT" for x, _ in insults)
            threat = any(x == "THREAT" for x, _ in marks) and evidence(menace, marks)[4] > 0
            if hit or threat:
                yield evidence(abuse, insults)[:4] if hit else np.zeros(4), threat

    def score(self, text: str) -> float:
        """Noisy or of the clauses; each clause's weight of evidence is log odds."""
        clean = 1 - self.base
        for sums, threat in self.matches(text):
            z = float(sums @ np.array(self.counts))
            clean *= (1 / (1 + math.exp(min(z, 50.0)))) if z > 0 else 1.0
            clean *= 0.2 if threat else 1.0
        return 1 - clean


KIND_OF = {x: symbol for symbol, words in MARKERS.items() for x in words}


def learn_stems(texts: list[str], toxic: list[int], sure: int = 8, purity: float = 0.9) -> dict[str, float]:
    """Word prefixes whose texts are nearly all toxic, each grown to what its words share, with log odds as weight.

    Support counts families of texts, not texts, so that copies of one toxic text don't make its other words insults: a
    family is the smallest hash of a text's words. A stem needs ``sure`` families, or three
    that no stem of more support explains.
    """
    prefixes = lambda found: {w[:k] for w in found for k in range(SHORT, min(len(w), SEED) + 1)}
    words: Counter[str] = Counter()
    posts: dict[str, list[int]] = defaultdict(list)
    family: list[int] = []
    for t, y in zip(texts, toxic, strict=True):
        if y and (found := set(LETTERS.findall(t.lower()))):
            words.update(found)
            for p in prefixes(found):
                posts[p].append(len(family))
            family.append(min(zlib.crc32(w.encode()) for w in found))
    least = 3
    posts = {p: d for p, d in posts.items() if len(d) >= least}
    clean: Counter[str] = Counter()
    live, heads, seen = posts.keys(), {p[:SHORT] for p in posts}, 0
    for t, y in zip(texts, toxic, strict=True):
        if y:
            continue
        clean.update(prefixes({w for w in set(LETTERS.findall(t.lower())) if w[:SHORT] in heads}) & live)
        seen += 1
        if seen in (50, 200, 800, 3200):  # what is impure already stays so
            live = {p for p in live if len(posts[p]) >= purity * (len(posts[p]) + clean[p])}
            heads = {p[:SHORT] for p in live}
    pure = {p for p in live if len(posts[p]) >= purity * (len(posts[p]) + clean[p])}
    first = [p for p in pure if not any(p[:k] in pure for k in range(SHORT, len(p)))]  # no shorter prefix is as pure
    support = {p: len({family[i] for i in posts[p]}) for p in first}
    kept: dict[str, float] = {}
    explained: set[int] = set()
    for p in sorted(first, key=lambda p: (-support[p], p)):
        if support[p] < sure and len({family[i] for i in posts[p]} - explained) < least:
            continue
        own = {w: n for w, n in words.items() if w.startswith(p)}
        stem = p
        while len(stem) < LONG:  # grow while the words that begin with it, weighed by texts, share the next letter
            nexts: Counter[str] = Counter()
            for w, n in own.items():
                nexts[w[len(stem) : len(stem) + 1]] += n
            (c, k), *_ = nexts.most_common(1)
            if not c or k < 0.98 * sum(nexts.values()):
                break
            stem += c
            own = {w: n for w, n in own.items() if w.startswith(stem)}
        # odds that a text with the stem is toxic, a half row added to either side
        kept[stem] = math.log((len(posts[p]) + 0.5) / (clean[p] + 0.5))
        explained.update(family[i] for i in posts[p])
    return kept


def fit_grammar(texts: list[str], toxic: list[int]) -> Grammar:
    """Stems, then the kinds' factors by ridge regression towards the prior, then the rate among texts without a match."""
    if len(set(toxic)) < 2:
        return Grammar()
    g = Grammar(learn_stems(texts, toxic))
    quick = g.automaton()
    rows, y, silent = [], [], []
    for t, label in zip(texts, toxic, strict=True):
        if next(quick.iter(t.lower()), None) and (found := [s for s, _ in g.matches(t)]):
            rows.append(np.sum(found, 0))
            y.append(label)
        else:
            silent.append(label)
    base = min(0.3, (sum(silent) + 0.5) / (len(silent) + 1))
    if not rows:
        return Grammar(g.stems, base=base)
    x, target = np.array(rows), np.array(y, float)
    w = PRIOR.copy()
    for _ in range(200):  # gradient steps of the logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w = np.clip(w - 0.05 * ((x.T @ (p - target)) / len(x) + 0.002 * (w - PRIOR)), 0.0, 2.0)
    return Grammar(g.stems, tuple(map(float, w)), base)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Grammar:
    """Grammar fitted on labelled rows that are not held out: at most train_rows, and train_bytes of text."""
    small_batches(docs.sparkSession)
    train = labels.where("crc32(cast(doc_id as string)) % 3 <> 1")
    sample = label_sample(docs, train, "toxic", train_rows, id_col, text_col).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    sample = written(sample, "labelled")  # so that docs are read once
    one = one_an_id(sample, "label", "row").select("doc_id", "label", "row")
    size = sample.groupBy("doc_id").agg(F.max(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size"), F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").collect()
    kept, total = [], 0
    for r in size:  # at most train_rows rows of numbers
        if total + r["size"] <= train_bytes:
            total += r["size"]
            kept.append((r.doc_id,))
    asked = F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id long"))
    own = sample.join(asked, "doc_id").join(F.broadcast(one), ["doc_id", "label", "row"])
    rows = sorted({(r.doc_id, r.label, r.text or "") for r in own.select("doc_id", "label", "text").toPandas().itertuples()})
    return fit_grammar([t for _, _, t in rows], [y for _, y, _ in rows])


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", toxic_at: float = TOXIC_AT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick = grammar.automaton()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            s = [grammar.score(t) if t and next(quick.iter(t.lower()), None) else grammar.base for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i is not None and in_fold(i) for i in ids], pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= toxic_at) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    return texts_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on labelled rows outside the held-out fold, then score all of docs."""
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    grammar = fit(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick = grammar.automaton()
        for b in batches:
            yield b.filter(pa.array([not t or next(quick.iter(t.lower()), None) is None or grammar.score(t) < TOXIC_AT for t in b.column(at).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)
