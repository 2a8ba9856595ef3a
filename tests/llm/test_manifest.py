import hashlib
import random
import zlib

import pytest

from watchline.llm.manifest import manifest, verify

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int"
KEYS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [*row[:4], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(hashes):
    """Root, and for each leaf its place and run of digests level by level."""
    ways, at, now = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(now) > 1:
        runs = [now[i : i + 16] for i in range(0, len(now), 16)]
        for k, way in enumerate(ways):
            way.append((at[k] % 16, runs[at[k] // 16]))
            at[k] //= 16
        now = [h(*run) for run in runs]
    return now[0], ways


def fold(digest, way):
    for slot, run in way:
        digest = h(*run[:slot], digest, *run[slot + 1 :])
    return digest


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((r, leaf(r, r[4])) for r in rows if r[1] == s), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((own, *climbed([x for _, x in own])))
    if not trees:
        return []
    root, tops = climbed([t[1] for t in trees])
    out = []
    for (own, subroot, ways), top in zip(trees, tops, strict=True):
        for (r, x), way in zip(own, ways, strict=True):
            path = way + top
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            low = r[4] and "".join(c.lower() if c.isascii() else c for c in r[4])
            now = fold(leaf(r, low) if changed else x, path)
            proof = h(*(d for slot, run in path for d in run[:slot] + run[slot + 1 :]))
            out.append((r[0], x, subroot, root, proof, now, now == root))
    return sorted(out, key=repr)


def rows(spark, docs):
    return sorted((tuple(r[k] for k in KEYS) for r in verify(spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)).collect()), key=repr)


def made(rng, sizes):
    ids = rng.sample(range(10**6), sum(sizes))
    docs = []
    for k, size in enumerate(sizes):
        for _ in range(size):
            text = "".join(rng.choices("abcXYZ É漢", k=rng.randint(0, 12)))
            docs.append((ids.pop(), None if k == 2 else f"s{k}é"[: rng.choice([3]) + k % 2], rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([text, text, None])))
    return docs


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [300, 1, 16, 17, 5], [1] * 19, [257, 1, 3] + [2] * 15])
def test_against_brute_force(spark, sizes):
    docs = made(random.Random(len(sizes)), sizes)
    assert rows(spark, docs) == brute(docs)


def test_null_ids_and_repeated_rows(spark):
    docs = made(random.Random(5), [20, 3, 4])
    docs += [docs[0], docs[0], (None, "s0é", None, None, None), (None, "s0é", "en", 3, "AB"), (None, None, None, None, None), (docs[1][0], "s0é", "de", 1, "twin")]
    assert rows(spark, docs) == brute(docs)


def test_no_rows(spark):
    assert rows(spark, []) == []
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    docs = [(1, "a", "en", 1, "Ab" * 2_000_000), (2, "a", "en", 1, "")]
    assert rows(spark, docs) == brute(docs)


def test_manifest_holds_every_parent(spark):
    docs = made(random.Random(9), [300, 1, 16])
    kept = manifest(spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)).collect()
    assert all(h(r.preimage) == r.digest for r in kept)
    assert sorted((r.over_sources, r.level, r.node) for r in kept if r.source != "s0é") == [(False, 1, 0), (True, 1, 0)]
    assert sum(r.source == "s0é" for r in kept) == 19 + 2 + 1
    assert {r.digest for r in kept if r.over_sources} == {brute(docs)[0][3]}
