"""The operators once more, in plain Python over lists of rows: what tests hold the queries against."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np

from factloom.llm import co_training, packing, quality_rules, toxicity


def removed(texts, width=200):
    """Of each text: bytes, removed bytes, spans, and what is left."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(t[i : i + width] for t in data for i in range(len(t) - width + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def digests(texts, width=200):
    return [(n, gone, spans, hashlib.sha256(left).hexdigest()) for n, gone, spans, left in removed(texts, width)]


def components(rows):
    """doc_id, size of the set, smallest id reachable, of rows (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def statistics(text):
    """Words, their characters, symbols, repeated lines, words in repeated windows, and the features of the trees."""
    text = text or ""
    white = " \t\n\x0b\x0c\r"
    words = []
    word = ""
    for c in text + " ":
        if c in white:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    n = len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    lines = [x for x in text.split("\n") if x.strip(white)]
    dup = len(lines) - len(set(lines))
    seen = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    repeat = len({j for i in range(n - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})
    chars = sum(map(len, words))
    if not n:
        return (0, 0, symbols, 0, 0), [0.0] * len(quality_rules.FEATURES)
    stops = sum(x.rstrip(white)[-1] in ".!?:;" for x in lines)
    upper, shout, digit = (sum(c in s for w in words for c in w) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!", "0123456789"))
    of_bytes = len("".join(words).encode()) and chars
    features = [symbols / n, dup / len(lines), repeat / n, upper / of_bytes, shout / n, digit / of_bytes, len(set(words)) / n, chars / n, math.log(n), stops / len(lines), math.log(n / len(lines))]
    return (n, chars, symbols, dup, repeat), features


def tree_score(trees, features):
    """Down each tree, one node after another."""
    total = trees.base
    for at in trees.roots.tolist():
        while trees.feature[at] >= 0:
            at = int(trees.left[at] if features[trees.feature[at]] <= trees.threshold[at] else trees.right[at])
        total += trees.value[at]
    return 1 / (1 + math.exp(-total))


def kept(trees, text):
    """The verdict of the quality rules."""
    (n, *_, repeat), features = statistics(text)
    return not (n < 10 or 100 * repeat > 20 * n) and tree_score(trees, features) >= 0.5


def toxic(grammar, text):
    return grammar.score(text or "") >= toxicity.TOXIC_AT


def cut(tokenizer, rows, capacity=1024, end=2):
    """doc_id, piece, start, length, crc of each piece of rows (doc_id, text)."""
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        first = (len(ids) - 1) % capacity + 1
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for k, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
            out.append((doc, k, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())))
    return out


def sequences(lengths, capacity=1024):
    """How many bins best fit decreasing opens: each piece into the fullest bin that holds it."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def check_packing(rows, pieces, capacity=1024):
    """rows of the packing hold exactly the pieces, without gaps, in as many sequences as best fit decreasing opens."""
    key = lambda xs: sorted(xs, key=repr)
    assert key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == key(pieces)
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values(), default=0) <= capacity and len(fill) == sequences([p[3] for p in pieces], capacity)


def co_train(text, meta, y, spare, pool_text, pool_meta, rounds, sure):
    """The rounds of co-training with lists: each view labels its surest rows for the other one."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    train = [i for i in range(len(y)) if not spare[i]]
    own = {0: [(text[i], y[i]) for i in train], 1: [(meta[i], y[i]) for i in train]}
    pool = {0: pool_text, 1: pool_meta}
    free = list(range(len(pool_text)))
    fit = lambda k: co_training.fit_logistic(np.array([x for x, _ in own[k]]), np.array([t for _, t in own[k]]))
    for _ in range(rounds):
        views = [fit(0), fit(1)]
        if not free:
            break
        for k in (0, 1):
            z = {i: float(views[k].logit(pool[k][i][None])[0]) for i in free}
            order = sorted(free, key=lambda i: z[i])
            n = min(sure, len(free))
            low = [i for i in order[: int(round(n * (1 - share)))] if z[i] < -2]
            high = [i for i in order[len(order) - int(round(n * share)) :] if z[i] > 2]
            for part, label in ((low, 0.0), (high, 1.0)):
                own[1 - k] += [(pool[1 - k][i], label) for i in part]
                free = [i for i in free if i not in set(part)]
    return fit(0), fit(1), len(free)


__all__ = ["check_packing", "co_train", "components", "cut", "digests", "kept", "packing", "removed", "sequences", "statistics", "toxic", "tree_score"]
