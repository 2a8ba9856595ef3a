import random
import re
import zlib
from collections import Counter

from watchline.llm.spelling import variants

SCHEMA = "doc_id long, text string, word int, n string"
KEYS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    forms, out = {}, []
    for w, c in words.items():
        others = [v for v in words if near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * c else None
        out.append((w, c, len(others)))
    rows = []
    for w, c, k in out:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, c, k, words[forms[w]] if forms[w] else None))
    return sorted(rows, key=repr)


def rows(spark, docs):
    return sorted((tuple(r[k] for k in KEYS) for r in variants(spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA)).collect()), key=repr)


def made(rng, n):
    letters = "aabbcé×ÿ"
    base = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(60)]

    def changed(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :], w])

    common = lambda: base[min(int(rng.expovariate(0.1)), 59)]
    return [(i, " ".join(rng.choice([str.upper, str.lower])(changed(common())) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_against_brute_force(spark):
    docs = made(random.Random(3), 120)
    docs += [docs[0], (None, docs[1][1]), (500, None), (501, ""), (502, "1 2 -- Ābcdefg ×÷×÷× " * 4)]
    expected = brute(docs)
    assert rows(spark, docs) == expected
    assert any(r[2] not in (r[0], r[1]) for r in expected)  # a chain of two forms or more
    assert any(r[4] > 5 for r in expected)


def test_ties_go_to_the_first_in_code_point_order(spark):
    docs = [(None, "house " * 3 + "mouse " * 7 + "éouse " * 7 + "louse " * 7)]
    assert [r for r in rows(spark, docs) if r[0] == "house"] == [("house", "louse", "louse", 3, 3, 7)]


def test_very_long_words(spark):
    long = "ab" * 20_000
    docs = [(None, f"{long} {long} {long} {long}c {long}c {long}c {long}c {long}c {long}c {long[:-1]} ")]
    docs += [(None, long[:-1]), (None, long[:-1])]
    assert rows(spark, docs) == brute(docs)


def test_no_rows(spark):
    assert rows(spark, []) == []
    assert rows(spark, [(1, None), (None, "")]) == []
