import hashlib
import random
import re

from watchline.llm import decontaminate
from watchline.llm.decontaminate import report, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def items_digest(items):
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w = fold(text)
        hit, found = set(), set()
        for item_id, item in items:
            v = fold(item)
            for i in range(max(0, len(v) - 9) if len(v) >= 10 else min(1, len(v))):
                g = v[i : i + 10]
                for j in range(len(w) - len(g) + 1):
                    if w[j : j + len(g)] == g:
                        hit.update(range(j, j + len(g)))
                        found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), items_digest(list(found)), bool(hit)))
    return sorted(out, key=repr)


def case(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "C", "d9", "é", "Éa", "x-y", "zz", "q", "漢字"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 14, 30])))) for i in range(15)] + [(99, None), (98, "..."), (3, "a b C d9")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 30)))]
        if rng.random() < 0.6:
            v = (rng.choice(items)[1] or "").split()
            s = rng.randint(0, 5)
            parts.append(" | ".join(v[s : s + rng.randint(5, 20)]))
        parts.append(" ".join(rng.choices(vocab, k=rng.randint(0, 30))))
        docs.append((i, "\n".join(parts)))
    return docs + [(None, "a b C d9 é"), (7, None), (8, ""), docs[3]], items


def rows(spark, docs, items):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int")
    got = report(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_against_brute_force(spark):
    docs, items = case(1)
    assert rows(spark, docs, items) == brute(docs, items)


def test_a_full_bitmap_and_shuffled_items_give_the_same(spark, monkeypatch):
    """A benchmark of any size goes the same way: the bitmap lets more through, the join decides."""
    docs, items = case(2)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 6)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 6)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert rows(spark, docs, items) == brute(docs, items)


def test_long_texts(spark, monkeypatch):
    docs, items = case(3)
    docs.append((500, " ".join(t or "" for _, t in docs)))
    monkeypatch.setattr("watchline.llm.common.steps.__defaults__", ("text", 200))
    assert rows(spark, docs, items) == brute(docs, items)


def test_stage_keeps_clean_rows_and_all_columns(spark):
    docs, items = case(4)
    docs = docs + docs[:2]
    d = spark.createDataFrame([(*x, "g", 1) for x in docs], "doc_id long, text string, gone string, n_words int")
    got = without_contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    clean = sorted((x for x, row in zip(docs, (brute([x], items)[0] for x in docs), strict=True) if not row[5]), key=repr)
    assert got.columns == d.columns and sorted((tuple(r)[:2] for r in got.collect()), key=repr) == clean
    none = spark.createDataFrame([], "item_id long, text string")
    assert without_contaminated(d, none).count() == len(docs) and without_contaminated(d.limit(0), none).count() == 0


def test_empty_tables(spark):
    assert rows(spark, [], [(1, "a b")]) == []
    assert rows(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
