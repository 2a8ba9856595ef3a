import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest
import xxhash

from watchline.llm.private import base, disclosures, sanitised, scan

SCHEMA = "doc_id long, text string, n_email string, spans int"
KEYS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sound(kind, shown):
    digits = [int(c) for c in shown if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in shown.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if sound(k, m[0])]


def value(text, span):
    kind, a, b = span
    return kind + ":" + (text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else re.sub(r"\D", "", text[a:b]))


def words(text):
    hidden = {i for _, a, b in plain_base(text) for i in range(a, b)}
    shown = "".join(" " if i in hidden else c.lower()[0] for i, c in enumerate(text))
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_]{3,}", shown)]


def terms(w):
    return [(a, s, e) for a, s, e in w] + [(f"{a} {b}", s, e) for (a, s, _), (b, _, e) in zip(w, w[1:], strict=False)]


def brute_disclosures(docs):
    texts = {t for _, t in docs if t}
    signed = lambda n: n - (n >> 63 << 64)
    holding, contexts, having = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        w = words(t)
        for term, _, _ in terms(w):
            having[term].add(t)
        near, beyond = defaultdict(set), defaultdict(set)
        for span in plain_base(t):
            v = value(t, span)
            holding[v].add(t)
            i = sum(s < span[1] for _, s, _ in w)
            left, right = w[max(0, i - 12) : i], w[i : i + 12]
            near[v].update(x for x, _, _ in terms(left) + terms(right))
            beyond[v].update(x for x, _, _ in w[max(0, i - 30) : max(0, i - 12)] + w[i + 12 : i + 30])
        for v in near:
            whole = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big", signed=True)
            context = min(signed(xxhash.xxh3_64_intdigest(x.encode())) for x in beyond[v]) if len(beyond[v]) >= 8 else whole
            for term in near[v]:
                contexts[v, term].add(context)
    out = {}
    for (v, term), seen in contexts.items():
        if len(seen) >= 3 and len(holding[v]) >= 3:
            known = math.log(len(texts) / len(holding[v]))
            out[v, term] = 1 + math.log(min(1, len(seen) / len(having[term]))) / known if known else 0.0
    return out


def brute(docs):
    marked = {term for (_, term), d in brute_disclosures(docs).items() if d >= 0.75}
    out = []
    for doc_id, text in docs:
        found = plain_base(text or "")
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        more = ",".join(f"term:{a}:{b}" for a, b in sorted({(a, b) for x, a, b in terms(words(text or "")) if x in marked}))
        n = [sum(k == kind for k, _, _ in found) for kind in PATTERNS]
        out.append((doc_id, *n, hashlib.sha256(shown.encode()).hexdigest(), ",".join(filter(None, [shown, more]))))
    return sorted(out, key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)


def rows(spark, docs):
    return sorted((tuple(r[k] for k in KEYS) for r in scan(frame(spark, docs)).collect()), key=repr)


def made(rng, n=150):
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 6))) for _ in range(300)]
    prose = lambda a, b: " ".join(rng.choices(vocab, k=rng.randint(a, b)))
    people = [("Zanbor Quill", "z.quill@mail.example.com"), ("İda Ormsk", "+1 (499) 555-6503"), ("Teal Quill", "8.8.8.8"), ("Oslo Vant", "4111 1111 1111 1111")]
    docs = []
    for i in range(n):
        text = prose(0, 60)
        if i % 4 == 0:
            name, where = people[i // 4 % 4]
            text += f" {name} writes from {where}. " + prose(0, 60)
        if i % 9 == 0:
            text += f" {people[i % 4][0].upper()} came. "
        if i % 5 == 0:
            text += rng.choice([" a@b.c+d@e.f ", " 1.2.3.4.5.6.7.300 ", " 256.1.1.1 ", " 1234567890123456789012 ", f" x{i}@host.example.org", " +12345 6789() ", " @x.y a@@b.c 1.2.3.4@h.i"])
        docs.append((i, text))
    return docs


def test_against_brute_force(spark):
    docs = made(random.Random(2))
    docs += [docs[0], docs[4], (900, docs[8][1]), (901, None), (902, ""), (None, docs[12][1]), (None, None)]
    expected = brute(docs)
    assert rows(spark, docs) == expected
    assert sum("term:" in r[-1] and r[1:5] == (0, 0, 0, 0) for r in expected) > 3  # names away from any address


def test_disclosures_against_brute_force(spark):
    docs = made(random.Random(4))
    docs += [(1000 + i, docs[4][1]) for i in range(30)]
    got = {(r.entity, r.term): r.disclosure for r in disclosures(frame(spark, docs)).collect()}
    expected = brute_disclosures(docs)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_copies_of_one_text_disclose_nothing(spark):
    rng = random.Random(6)
    text = [f"w{i}x" for i in range(120)]
    text[60] = "copied@mail.example.com"
    near = []
    for i in range(60):  # near copies: a word or two replaced
        t = list(text)
        for _ in range(2):
            k = rng.choice([k for k in range(120) if k != 60])
            t[k] = f"v{rng.randrange(10**6)}"
        near.append((i, " ".join(t)))
    docs = near + [(100 + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(50))) for i in range(200)]
    assert not [r for r in scan(frame(spark, docs)).collect() if "term" in r.spans]


@pytest.mark.parametrize("seed", range(6))
def test_base_is_what_the_patterns_find(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        text = "".join(rng.choices(["a", "Z", "@", "@", ".", ".", "-", "+", "%", "_", " ", "1", "25", "255", "256", "0", "(", ")", "é", "4111111111111111", "x@y.z", "1.2.3.4"], k=rng.randint(0, 40)))
        kinds = ["email", "ip", "card", "phone"]
        assert [(kinds[k], a, b) for k, a, b in base(text)] == plain_base(text), text


def test_long_runs_cost_no_more():
    began = time.time()
    for run in ("a" * 10**6 + " @", "1." * 10**6, "1" * 10**6, "+1" + " " * 10**6, "a@" * 10**6, "1-" * 10**6):
        base(run)
    assert time.time() - began < 30


def test_sanitised_text(spark):
    docs = made(random.Random(2)) + [(901, None), (902, "")]
    got = {r.doc_id: r.text for r in sanitised(frame(spark, docs)).collect()}
    assert len(got) == len(docs) and got[901] is None and got[902] == ""
    text = got[0]
    assert "[EMAIL]" in text and "z.quill" not in text and "Zanbor" not in text and "writes" in text
    assert all(not plain_base(t or "") or "+" in t or "@" in t for t in got.values())
    clean = [i for i, t in docs if i % 4 and i % 5 and i % 9 and i < 900]
    before = dict(docs)
    assert sum(got[i] == before[i] for i in clean) > 0.9 * len(clean)


def test_no_rows(spark):
    assert rows(spark, []) == []
    assert rows(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")])
    assert sanitised(frame(spark, [])).collect() == []
