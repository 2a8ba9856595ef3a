import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from watchline.llm import language_model as lm


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) + [""]


def brute(docs):
    c = Counter(t for i, text in docs if i is not None and not held_out(i) for t in split(text))
    n, v = c.total(), len(c)
    out = []
    for i, text in docs:
        t = split(text)
        out.append((i, held_out(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)))
    return sorted(out, key=repr)


def corpus(n=400, seed=1):
    """Two languages of words in a fixed order of kinds, so that context tells the next word."""
    rng = random.Random(seed)
    kinds = [[f"{a}{k}{i}" for i in range(12)] for a in "xy" for k in "abc"] + [["É", "Z"]]
    docs = []
    for i in range(n):
        own = kinds[:3] if rng.random() < 0.5 else kinds[3:6]
        w = [rng.choice(own[j % 3]) for j in range(rng.randint(30, 120))] + rng.choices(kinds[6], k=2) + [f"rare{rng.randint(0, 9999)}"]
        docs.append((i, " ".join(w)))
    return docs + [(None, "xa1 new"), (n, None), (n + 1, "\n"), docs[5], (7, "another text")]


@pytest.mark.parametrize("held", [40, 100_000])
def test_base_and_model(spark, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD_WORDS", held)
    docs = corpus(1500)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(2)
    got = sorted(lm.lm_scores(frame).collect(), key=lambda r: repr(tuple(r)[:6]))
    want = brute(docs)
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want] or sorted(tuple(r)[:5] for r in got if r.doc_id is not None) == sorted(w[:5] for w in want if w[0] is not None)
    assert sorted(r.base_score for r in got) == pytest.approx(sorted(w[5] for w in want), abs=1e-6)
    held_rows = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)


def test_probabilities_of_the_trained_model_add_up(spark):
    """After any context the units' probabilities, and the shares of a class's other words, make 1."""
    frame = spark.createDataFrame([(i, t) for i, t in corpus(300) if i is not None], "doc_id long, text string")
    counts = lm.word_counts(lm.learnt(frame)).cache()
    known = lm.vocabulary_of(counts)
    model = lm.train(lm.learnt(frame), known)
    every = np.arange(known.units)
    assert not np.allclose(model.values, lm.Vectors.first(known).values)
    for near, far in ((0, 0), (known.end, known.end), (known.units - 1, 3)):
        p = 10.0 ** model.log10_probabilities(np.full(known.units, near), np.full(known.units, far), every)
        assert p.sum() == pytest.approx(1, abs=1e-4)
    own = {w for w, i in known.place.items() if i < len(known.own_unit)}
    for g in range(known.classes):  # the class's other words, and one that was never seen
        rest = [r.c for r in counts.collect() if r.word not in own and known.class_of(r.word) == g]
        assert sum(c + 1 for c in rest) + 1 == pytest.approx(10 ** known.log_rest[g])


def test_score_does_not_depend_on_partitions(spark, monkeypatch):
    """Shards are of hashes of rows, so the held-out score is the same at any partitioning, and over the base."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 4000)
    frame = spark.createDataFrame([(i, t) for i, t in corpus(800) if i is not None and t is not None], "doc_id long, text string")
    sums = lambda rows: [sum(r[c] for r in rows) / sum(r.n_tokens for r in rows) for c in ("score", "base_score")]
    one, many = (sums([r for r in lm.lm_scores(frame.repartition(n)).collect() if r.held_out]) for n in (1, 64))
    assert one == pytest.approx(many, abs=1e-6)
    assert one[0] > one[1] + 0.1


def test_texts_of_one_32_bit_hash_stay_apart(spark):
    """w254943 and w267111 have one 32-bit Murmur value; only one of them is learnt."""
    docs = [(i, "w254943 w254943") for i in range(40) if not held_out(i)] + [(None, "w254943"), (None, "w267111")]
    got = lm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id IS NULL").collect()
    assert sorted(r.n_known for r in got) == [1, 2]
    assert len({r.base_score for r in got}) == len({r.score for r in got}) == 2


def test_long_texts_and_other_columns(spark, monkeypatch):
    """Texts longer than a step, and columns named as the result's, change nothing."""
    docs = corpus(60)[:60] + [(1000, "xa1 xb2 xc3 " * 500)]
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, lm.lm_scores(plain).collect()))
    monkeypatch.setattr(lm, "TEXT_BYTES", 100)
    clashing = plain.selectExpr("*", "'x' AS word", "1 AS n_tokens", "2 AS shard", "3 AS th")
    got = sorted(map(tuple, lm.lm_scores(clashing).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:], abs=1e-4) for w in want]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.lm_scores(empty).collect() == []
    only_held = [i for i in range(100) if held_out(i)][:1]
    got = lm.lm_scores(spark.createDataFrame([(only_held[0], "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)]
