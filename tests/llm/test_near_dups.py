import random
import re

import numpy as np
import pytest

from watchline.llm import near_dups
from watchline.llm.graphs import components
from watchline.llm.near_dups import COLLISION, groups_of, registers


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, s in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    out = [(i, len(s), None if i is None else find(i) if s else i, i is None or not s or find(i) == i) for i, s in sets]
    return sorted(out, key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["É", "漢字", "A", "B", "."]
    docs, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = [x.upper() for x in w]
        else:
            w = rng.choices(vocab, k=rng.choice([1, 3, 5, 8, 20, 60, 200]))
        base.append(w)
        docs.append((i, rng.choice([" ", "\n "]).join(w)))
    return docs + [(n, None), (n + 1, " \n"), (None, docs[0][1]), docs[4], (n + 2, ""), (n + 3, "One"), (n + 4, "one")]


def got(spark, docs):
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, n long")
    return sorted((tuple(r) for r in groups_of(d).collect()), key=repr)


@pytest.mark.parametrize(("rounds", "small"), [(0, 2), (0, 64), (2, 3)])
def test_against_brute_force(spark, monkeypatch, rounds, small):
    monkeypatch.setattr(near_dups, "SMALL", small)
    monkeypatch.setattr(near_dups, "ROUNDS", rounds)
    monkeypatch.setattr(near_dups, "BLOCK", 7)
    docs = corpus(rounds)
    want = brute(docs)
    assert sum(r[0] != r[2] for r in want) > 30
    assert got(spark, docs) == want


def test_no_rows_and_no_links(spark):
    assert got(spark, []) == []
    docs = [(1, "a b c d e f"), (2, "g h i j k l"), (3, None)]
    assert got(spark, docs) == brute(docs)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    for shared, size in ((700, 850), (80, 90), (8, 9), (300, 1000)):
        a = np.sort(pool[:size])
        b = np.sort(np.concatenate([pool[:shared], pool[2000 : 2000 + size - shared]]))
        r = registers([a, b])
        share = (r[0] == r[1]).mean()
        assert abs((share - COLLISION) / (1 - COLLISION) - shared / (2 * size - shared)) < 0.15


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for link in links for x in link if x is not None}
    for _ in range(200):
        for a, b in links:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x not in (300,)}
