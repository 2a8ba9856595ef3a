import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from watchline.llm import toxicity as tox

INSULTS = ["blockhead", "nitwit", "dunce", "oaf"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    parts = ["re", "ti", "on", "an", "the", "er", "in", "es", "ou", "st", "lo", "que"]
    vocab = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(1500)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randint(20, 80))
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "you nitwit nitwit dunce", "x"), (5000, None, "x"), (5001, "", "x"), docs[2]]
    d, marks = frames(spark, docs + odd, labels + [(None, 1), (6000, 1), (3, None)])
    got = tox.toxicity(d, marks).collect()
    assert len(got) == len(docs) + len(odd)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == held_out(r.doc_id) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert not by_id[None].held_out and by_id[5000].score == by_id[5001].score < 0.5


def test_inserted_characters(spark):
    docs, labels = corpus(seed=2)
    model = tox.fit(*frames(spark, docs, labels), tox.learnable())
    column = pa.array(["on the n.i.t.w.i.t re", "the nittwit and duncce", "b l o c k h e a d re n i t w i t", "on the re ti", None])
    scores = model.scores(model.features(column))
    assert (scores[:3] > 0.5).all() and (scores[3:] < 0.5).all()


def test_nothing_to_learn(spark):
    d, marks = frames(spark, [(1, "a b", "x")], [(1, 0)])
    assert [(r.score, r.predicted) for r in tox.toxicity(d, marks.where("false")).collect()] == [(0.0, 0)]
    assert tox.toxicity(d.where("false"), marks).collect() == []
    assert [tuple(r) for r in tox.without_toxic(d, marks).collect()] == [(1, "a b", "x")]


def test_table_equals_kernel():
    strings, landmarks = ["nitwit", "nit-wit", "été", "a", ""], ["nitwit", "dunce"]
    weights = np.array([0.7, -0.2])
    rows, slots, w = tox.runs(landmarks)
    table = np.zeros(tox.SIZE)
    np.add.at(table, slots, w * weights[rows] / tox.norms(2, rows, w)[rows])
    model = tox.Model(table, 0.0, np.zeros(3), np.ones(3), np.ones(3), 0.0)
    assert model.margins(strings)[:4] == pytest.approx(tox.kernel(strings, landmarks)[:4] @ weights, abs=1e-5)


def test_kernel_by_brute_force():
    def described(word):
        chars = ["<", *word, ">"]
        found = {}
        for a in range(len(chars)):
            for b in range(a + 1, len(chars)):
                for c in range(b + 1, min(len(chars), a + 5)):
                    key = chars[a], chars[b], chars[c]
                    found[key] = found.get(key, 0.0) + tox.DECAY ** (c - a - 2)
        # As the operator does, each run of a word counts for the norm by itself.
        single = sum(tox.DECAY ** (2 * (c - a - 2)) for a in range(len(chars)) for b in range(a + 1, len(chars)) for c in range(b + 1, min(len(chars), a + 5)))
        return found, single**0.5

    ours, theirs = ["nitwit", "nittwit", "n1twit", "oaf", "été", "blockhead"], ["nitwit", "oaf"]
    got = tox.kernel(ours, theirs)
    for i, one in enumerate(ours):
        for j, other in enumerate(theirs):
            (a, n), (b, m) = described(one), described(other)
            assert got[i, j] == pytest.approx(sum(v * b.get(k, 0.0) for k, v in a.items()) / (n * m), abs=1e-4)


def test_first_words_by_brute_force(spark):
    docs, labels = corpus(n=120, seed=3)
    marks = dict(labels)
    sample = spark.createDataFrame([(t, bool(marks[i])) for i, t, _ in docs], "text string, toxic boolean")
    got = {(r.toxic, r.word): r.n for r in tox.first_words(tox.bags(sample).checkpoint(), sum(marks.values()) / len(docs)).collect()}
    sets = [(set(t.split()), marks[i]) for i, t, _ in docs]
    share = sum(marks.values()) / len(docs)
    t, n = Counter(w for s, y in sets if y for w in s), Counter(w for s, _ in sets for w in s)
    z = {w: (t[w] - n[w] * share) / (n[w] * share + 0.5) ** 0.5 for w in n}
    best = [max((z[w], w) for w in s) for s, y in sets if not y]
    limit = tox.START * np.median([b for b, _ in best])
    want = {(True, w): t[w] for w in z if t[w] and z[w] > limit}
    assert want
    for (_, w), c in Counter(best).items():
        want[False, w] = want.get((False, w), 0) + c
    assert got == want
