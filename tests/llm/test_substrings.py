import hashlib
import random
import re

from watchline.llm.substrings import dedup


def brute(docs, width):
    listed = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in listed:
        if i is not None:
            for s in range(len(w) - width + 1):
                key = tuple(w[s : s + width])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in listed:
        gone = set()
        for s in range(len(w) - width + 1):
            if i is not None and first[tuple(w[s : s + width])] < i:
                gone.update(range(s, s + width))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, docs, width=50):
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, n_words int")
    return sorted((tuple(r) for r in dedup(d, width).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "漢字", "x\x1cy"]
    passages = [rng.choices(vocab, k=rng.choice([49, 50, 51, 60, 120])) for _ in range(6)]
    docs = []
    for i in range(80):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choices(vocab, k=rng.randint(0, 60))
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randint(0, 8)
                w += p[a : len(p) - rng.randint(0, 8)]
        docs.append((rng.randint(0, 60), rng.choice([" ", "\n", " \t "]).join(w)))
    docs += [docs[3], (99, docs[3][1]), (None, docs[3][1]), (100, None), (101, ""), (102, "a " * 200), (103, "a " * 170), (104, "a b " * 60), (105, "b a " * 60)]
    return docs


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        want = brute(docs, 50)
        assert sum(x[2] for x in want) > 500
        assert got(spark, docs) == want


def test_empty_table(spark):
    assert got(spark, []) == []
