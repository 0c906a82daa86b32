"""The toxicity grammar: transducers against a plain reading of what they mean, and the bounds of the fit."""

import itertools
import random

import numpy as np
import pytest

from factloom.llm import toxicity
from factloom.llm.toxicity import CLAUSE, LETTERS, MARKERS, QUOTES, Grammar


def plain_reading(g, text):
    """Each clause's weights by kind, and whether it is a threat, word by word from the definitions."""
    out = []
    for clause in CLAUSE.split(text.lower()):
        words = [(m.group(), m.start(), m.end()) for m in LETTERS.finditer(clause)]
        insult = [g.insult(x) for x, _, _ in words]
        is_a = lambda i, kind: not insult[i] and words[i][0] in MARKERS[kind]  # noqa: E731, B023
        sums = np.zeros(4)
        for i, (_, a, b) in enumerate(words):
            if not insult[i]:
                continue
            if any(is_a(j, "SAYS") for j in range(i)) or a and clause[a - 1] in QUOTES and clause[b : b + 1] and clause[b] in QUOTES:
                kind = 3
            elif any(is_a(j, "NOT") for j in range(max(0, i - 3), i)):
                kind = 2
            else:
                kind = int(any(is_a(j, "TARGET") for j in range(len(words))))
            sums[kind] += insult[i]
        of = lambda kind: [i for i, (x, _, _) in enumerate(words) if x in MARKERS[kind]]  # noqa: E731, B023
        threat = any(f < t < y for f, t, y in itertools.product(of("FUTURE"), of("THREAT"), of("TARGET")))
        if sums.any() or threat:
            out.append((sums, threat))
    return out


def test_transducers_mean_what_they_say():
    g, r = Grammar({"idiot": 5.0, "moro": 3.0, "kill": 1.0}), random.Random(8)
    some = ["you", "idiot", "morons", "not", "said", "will", "kill", "the", "never", "burn", "'idiot'", '"moron"', "a", '"', "'", ".", "!", "\n", "il", "x'idiot"]
    seen = np.zeros(5)
    for _ in range(4000):
        text = " ".join(r.choice(some) for _ in range(r.randint(0, 14)))
        got, want = list(g.matches(text)), plain_reading(g, text)
        assert len(got) == len(want), text
        for (a, x), (b, y) in zip(got, want, strict=True):
            assert a.tolist() == pytest.approx(b.tolist()) and x == y, text
            seen += np.append(b > 0, y)
    assert seen.min() > 50  # every kind is met


def test_one_path_is_accepted():
    abuse, _ = toxicity.cascades()
    for clause in itertools.product(toxicity.INPUT, repeat=4):
        alive = dict.fromkeys(abuse.starts, 1)
        for symbol in clause:
            then = {}
            for state, n in alive.items():
                for to, _ in abuse.step(state, symbol):
                    then[to] = then.get(to, 0) + n
            alive = then
        assert sum(n for state, n in alive.items() if state in abuse.finals) == 1


def test_other_markers():
    g = Grammar({"idiot": 5.0}, markers=MARKERS | {"NOT": frozenset(["hardly"])})
    assert g.score("hardly an idiot") < g.score("not an idiot") == g.score("an idiot")


def test_the_fit_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, ("you goblin " if i % 2 else "fine day ") + f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 20) for i in range(60)] + [(60, "goblin " * 100_000), (None, "goblin"), (61, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(60, 1), (61, 0), (None, 1)], "doc_id long, toxic int")
    whole, some = toxicity.fit(docs, labels), toxicity.fit(docs, labels, train_bytes=20_000)
    assert any("goblin".startswith(s) for s in whole.stems) and any("goblin".startswith(s) for s in some.stems)
    assert toxicity.fit(docs, labels, train_bytes=0) == Grammar() == toxicity.fit(docs.limit(0), labels) == toxicity.fit(docs, labels.where("toxic = 1"))


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "you idiot"), (2, None), (None, "")], "doc_id long, text string").selectExpr("*", "1 as label", "2 as score", "3 as row")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 4 and toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).count() == 4
