import random

import pytest

from watchline.llm.site_quality import site_quality


def corpus():
    rng = random.Random(1)
    vocab = "re tion an the er in es ou st lo que word text line".split()
    docs, labels = [], []
    for i in range(400):
        host = rng.choice(["a", "b", "c", None, "rare"] if i % 40 == 0 else ["a", "b", "c"])
        good = rng.random() < {"a": 0.95, "b": 0.9, "c": 0.3}.get(host, 0.5)
        w = rng.choices(vocab, k=rng.randint(30, 90))
        docs.append((i, " ".join(w if good else [x + "###" for x in w]), host, rng.choice(["en", "de", None]), 1))
        if i % 2:
            labels.append((i, int(good)))
    return docs, labels


def test_evidence_and_shrinkage(spark):
    docs, labels = corpus()
    odd = [(None, "word", "a", "en", 1), (900, None, "d", None, 1), (901, "", None, None, 1), docs[0]]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, source string, lang string, kept int")
    got = site_quality(d, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")).collect()
    assert len(got) == len(docs) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].kept == ("###" not in text) for i, text, *_ in docs)
    host = {h: {by_id[i].host_posterior for i, _, s, *_ in docs if s == h} for h in ("a", "c")}
    assert len(host["a"]) == len(host["c"]) == 1 and max(host["a"]) > max(host["c"])
    assert all(0 < r.posterior < 1 for r in got)


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a b", "h", "en")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    (row,) = site_quality(d, none).collect()
    assert row.evidence == pytest.approx(0.5) and row.posterior == pytest.approx(0.5)
    assert site_quality(d.where("false"), none).collect() == []
