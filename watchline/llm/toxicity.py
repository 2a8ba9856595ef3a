"""Toxicity by a subsequence string kernel.

A word is described by its gapped runs of three characters (word ends count as characters), each weighed
down by its gaps, so that insults with characters put in or left out stay near. Labels are of texts, so a support
vector machine over kernel values to landmark words (the Nyström map) learns from labelled texts as bags of words
(multiple instances): a text is as toxic as its most toxic word. In each round every other text gives the word that
speaks most against its label, and the toxic texts the words that speak for theirs; the next machine separates these.
As the machine is linear in kernel values, all landmarks fold into one table of weights, and a word costs one look-up
for each gapped run. A text's score is a logistic function of its words' margins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchline.llm.common import coded, crc_remainder, free_name, staged, steps, texts, words

#: Labelled texts of each kind that are learnt from at most, those of the least hashes of their ids.
TOXIC_TEXTS, OTHER_TEXTS = 2000, 4000
LANDMARKS = 192
#: Rounds of choosing words of the labelled texts. The first takes words of toxic texts that go with the label START times as
#: clearly (in standard deviations) as the clearest word of the median other text does by chance.
ROUNDS, START = 4, 1.5
#: Cost of all toxic and of all other texts on the wrong side; a word counts for so many other texts at most; weight of the squared norm.
TOXIC_COST, OTHER_COST, OTHERS_AT_MOST, RIDGE = 2000.0, 4000.0, 3, 1.0
#: A word is on the toxic side from this margin.
SIDE = 0.5
SIZE, DECAY = 1 << 16, 0.6
#: Words whose gapped runs are held at once, and bytes of text of one step.
WORDS_AT_ONCE, TEXT_BYTES = 10_000, 1 << 20
#: Places of the second and third character, from the first.
GAPS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
FIRST, LAST = 0x110000, 0x110001


def plain(distinct: list[str]) -> list[str]:
    """Words in small letters, without anything but letters and digits."""
    lowered = pc.utf8_lower(pa.array(distinct, pa.string()))
    return pc.replace_substring_regex(lowered, pattern=r"[^\p{L}\p{N}]+", replacement="").to_pylist()


def runs(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gapped runs of all strings: the string of each, its slot, and its weight."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    owner = np.repeat(np.arange(len(strings)), lengths + 2)
    chars = np.full(len(owner), FIRST, np.uint32)
    ends = np.cumsum(lengths + 2)
    chars[ends - 1] = LAST
    inner = np.ones(len(owner), bool)
    inner[ends - 1] = inner[ends - lengths - 2] = False
    chars[inner] = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    rows, slots, weights = [], [], []
    for i, j in GAPS:
        n = max(0, len(owner) - j)
        same = np.flatnonzero(owner[:n] == owner[j : j + n])
        h = chars[same] * np.uint32(0x9E3779B1) + chars[same + i] * np.uint32(0x85EBCA77) + chars[same + j] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        rows.append(owner[same])
        slots.append((h >> np.uint32(16)).astype(np.int64))
        weights.append(np.full(len(same), DECAY ** (j - 2), np.float32))
    return np.concatenate(rows), np.concatenate(slots), np.concatenate(weights)


def norms(n: int, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.sqrt(np.bincount(rows, weights**2, n)) + 1e-9


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values of strings to landmarks."""
    rows, slots, weights = runs(landmarks)
    table = np.zeros((SIZE, len(landmarks)), np.float32)
    np.add.at(table, (slots, rows), weights)
    table /= norms(len(landmarks), rows, weights)[None, :]
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    for a in range(0, len(strings), 2000):
        part = strings[a : a + 2000]
        rows, slots, weights = runs(part)
        values = np.zeros((len(part), len(landmarks)), np.float32)
        np.add.at(values, rows, table[slots] * weights[:, None])
        out[a : a + 2000] = values / norms(len(part), rows, weights)[:, None]
    return out


@dataclass
class Model:
    """Weights by slot, the machine's bias, and the logistic function over a text's features."""

    table: np.ndarray
    bias: float
    center: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    intercept: float

    def margins(self, strings: list[str]) -> np.ndarray:
        """The machine's value for each word; words without letters or digits have -1."""
        out = np.empty(len(strings))
        for a in range(0, len(strings), WORDS_AT_ONCE):
            part = strings[a : a + WORDS_AT_ONCE]
            rows, slots, weights = runs(part)
            value = np.bincount(rows, self.table[slots] * weights, len(part)) / norms(len(part), rows, weights) + self.bias
            out[a : a + len(part)] = np.where(np.fromiter(map(len, part), np.int64, len(part)) > 0, value, -1.0)
        return out

    def features(self, column: pa.Array) -> np.ndarray:
        """Of each text: the greatest margin, how many words are on the toxic side, in all and in share."""
        offsets, flat = words(texts(column))
        codes, distinct = coded(flat)
        strings = plain(distinct)
        extra_row, extra = spelled(codes, strings, offsets)
        margin = self.margins(strings + extra)
        rows = np.concatenate([np.repeat(np.arange(len(column)), np.diff(offsets)), extra_row]).astype(np.int64)
        value = np.concatenate([margin[codes], margin[len(strings) :]])
        top = np.full(len(column), -1.0)
        np.maximum.at(top, rows, value)
        toxic = np.bincount(rows, value > SIDE, len(column))
        return np.stack([np.clip(top, -1, 1), np.log1p(np.minimum(toxic, 20)), np.minimum(toxic / (1 + np.diff(offsets)), 0.2)], 1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.center) / self.scale @ self.coefficients + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def spelled(codes: np.ndarray, strings: list[str], offsets: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Words spelt with spaces: runs of four or more one-letter words of a text, and the text of each."""
    single = np.fromiter((len(s) == 1 for s in strings), bool, len(strings))[codes] if len(codes) else np.empty(0, bool)
    at = np.flatnonzero(single)
    if len(at) < 4:
        return np.empty(0, np.int64), []
    row = np.searchsorted(offsets, at, side="right") - 1
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(row) > 0)) + 1
    found_row, found = [], []
    for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
        if b - a >= 4:
            found_row.append(row[a])
            found.append("".join(strings[codes[i]] for i in at[a:b]))
    return np.array(found_row, np.int64), found


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Weights and bias of a support vector machine with squared hinge loss, by Newton steps."""
    full = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(full.shape[1])
    ridge = RIDGE * np.eye(full.shape[1])
    ridge[-1, -1] = 1e-6
    before = None
    for _ in range(rounds):
        inside = y * (full @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        a = full[inside] * cost[inside, None]
        w = np.linalg.solve(ridge + a.T @ full[inside], a.T @ y[inside])
    return w[:-1], w[-1]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    full = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(full.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        h = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve((full * h[:, None]).T @ full + 1e-3 * np.eye(len(w)), full.T @ (weight * (y - p)) - 1e-3 * w)
        w += step
    return w[:-1], w[-1]


def landmarks_of(toxic: list[str], support: np.ndarray, other: list[str]) -> list[str]:
    """Toxic words that many toxic texts have (``support``) and that are far from each other, then the other words
    nearest to them."""
    chosen = [int(support.argmax())]
    near = kernel(toxic, [toxic[chosen[0]]])[:, 0]
    while len(chosen) < min(len(toxic), LANDMARKS * 2 // 3):
        chosen.append(int((support * (1 - near)).argmax()))
        near = np.maximum(near, kernel(toxic, [toxic[chosen[-1]]])[:, 0])
    picked = [toxic[i] for i in dict.fromkeys(chosen)]
    if other:
        closest = np.argsort(-kernel(other, picked).max(1), kind="stable")[: LANDMARKS - len(picked)]
        picked += [other[i] for i in closest]
    return picked


def bags(sample: DataFrame) -> DataFrame:
    """The distinct words of each text, spelt ones as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, step_bytes=TEXT_BYTES):
            offsets, flat = words(texts(batch.column("text")))
            codes, distinct = coded(flat)
            strings = plain(distinct)
            row, extra = spelled(codes, strings, offsets)
            found = [sorted({strings[c] for c in np.unique(codes[a:b])} - {""}) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            for i, word in zip(row, extra, strict=True):
                found[i].append(word)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["toxic", "words"])

    return sample.mapInArrow(run, "toxic boolean, words array<string>")


def first_words(told: DataFrame, share: float) -> DataFrame:
    """``toxic, word, n``: words by how much oftener than by chance toxic texts have them; n counts texts."""
    pairs = told.withColumn("bag", F.monotonically_increasing_id()).select("bag", "toxic", F.explode("words").alias("word"))
    counts = pairs.groupBy("word").agg(F.count_if("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    expected = F.col("n") * share
    clear = staged(counts.select("word", "t", ((F.col("t") - expected) / F.sqrt(expected + 0.5)).alias("z")))
    best = staged(pairs.join(clear, "word").groupBy("bag", "toxic").agg(F.max(F.struct("z", "word")).alias("best")))
    limit = (best.where(~F.col("toxic")).agg(F.median("best.z")).first()[0] or 0.0) * START
    toxic = clear.where((F.col("t") > 0) & (F.col("z") > limit)).select(F.lit(True).alias("toxic"), "word", F.col("t").alias("n"))
    if toxic.isEmpty():  # a few texts only: the clearest word of each
        toxic = best.where("toxic").groupBy("toxic", "best.word").agg(F.count(F.lit(1)).alias("n"))
    return toxic.union(best.where(~F.col("toxic")).groupBy("toxic", "best.word").agg(F.count(F.lit(1)).alias("n")))


def telling_words(told: DataFrame, model: Model) -> DataFrame:
    """``toxic, word, n``: all words of toxic texts on the toxic side, or the one nearest to it if it is above 0; of other
    texts the one nearest to it; n counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, toxic = batch.column("words"), batch.column("toxic").to_numpy(zero_copy_only=False)
            codes, distinct = coded(lists.flatten())
            if not len(codes):
                continue
            margin = model.margins(distinct)[codes]
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            top = np.full(len(lists), -np.inf)
            np.maximum.at(top, owner, margin)
            nearest = np.flatnonzero(margin == top[owner])
            _, first = np.unique(owner[nearest], return_index=True)
            take = np.zeros(len(codes), bool)
            take[nearest[first]] = True
            take = np.where(toxic[owner], (take & (margin > 0)) | (margin > SIDE), take)
            at = np.flatnonzero(take)
            yield pa.RecordBatch.from_arrays([pa.array(toxic[owner[at]]), pa.array([distinct[c] for c in codes[at]])], names=["toxic", "word"])

    return told.mapInArrow(run, "toxic boolean, word string").groupBy("toxic", "word").agg(F.count(F.lit(1)).alias("n"))


def word_machine(toxic: dict[str, int], other: dict[str, int], toxic_texts: int, other_texts: int) -> Model | None:
    """A machine that separates words by the number of texts they speak for; a word of both kinds is of the one with more."""
    ours = sorted(w for w, n in toxic.items() if n > other.get(w, 0))
    theirs = sorted(w for w, n in other.items() if n >= toxic.get(w, 0))
    if not ours:
        return None
    support = np.array([toxic[w] for w in ours]) / toxic_texts
    picked = landmarks_of(ours, support, theirs)
    values, vectors = np.linalg.eigh(kernel(picked, picked).astype(float))
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])
    against = np.array([min(other[w], OTHERS_AT_MOST) for w in theirs]) / other_texts
    y = np.concatenate([np.ones(len(ours)), -np.ones(len(theirs))])
    w, bias = machine(kernel(ours + theirs, picked) @ root, y, np.concatenate([TOXIC_COST * support, OTHER_COST * against]))
    rows, slots, weights = runs(picked)
    table = np.zeros(SIZE)
    np.add.at(table, slots, weights * (root @ w)[rows] / norms(len(picked), rows, weights)[rows])
    return Model(table, float(bias), np.zeros(3), np.ones(3), np.ones(3), 0.0)


def alike() -> Column:
    """A number that copies of a text, and most near copies, have in common: two least hashes of its words."""
    listed = F.split(F.lower("text"), "\\s+")
    least = lambda seed: F.array_min(F.transform(listed, lambda w: F.xxhash64(w, F.lit(seed))))
    return F.xxhash64(least(0), least(1))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model | None:
    """A model of the labelled rows for which ``allowed`` holds; None if they are not of both kinds.

    Rows without a label or an id teach nothing; of several labels of one id, the highest counts.
    """
    marked = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    # Copies of one text would make its words seem to go with its label: of texts alike, one is learnt from.
    told = docs.where(F.col("text").isNotNull()).select("doc_id", alike().alias("alike")).join(marked, "doc_id")
    firsts = staged(told.groupBy("toxic", "alike").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    some = lambda toxic, n: firsts.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = some(True, TOXIC_TEXTS).union(some(False, OTHER_TEXTS))  # bounded, so it may be broadcast
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One text of each id, the one of the least hash, so that the bounds hold for the sample too.
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("text"), "text")).alias("row"))
    sample = staged(one.select("row.text", "row.toxic"))
    total = sample.agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("u")).first()
    share = marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not total.t or not total.u:
        return None
    told = staged(bags(sample))
    model, other = None, Counter()
    for _ in range(ROUNDS):
        # One row for each word of the bounded sample that speaks for a text, not all its words.
        found = (first_words(told, total.t / (total.t + total.u)) if model is None else telling_words(told, model)).collect()
        other.update({r.word: r.n for r in found if not r.toxic})
        better = word_machine({r.word: r.n for r in found if r.toxic}, other, total.t, total.u)
        if better is None:
            break
        model = better
    if model is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, step_bytes=TEXT_BYTES):
            f = model.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, i]) for i in range(3)), batch.column("toxic")], names=["a", "b", "c", "toxic"])

    got = sample.mapInArrow(run, "a double, b double, c double, toxic boolean").toPandas()
    f, y = got[["a", "b", "c"]].to_numpy(), got["toxic"].to_numpy().astype(float)
    model.center, model.scale = f.mean(0), f.std(0) + 1e-6
    weight = np.where(y > 0, share * len(y) / max(1, y.sum()), (1 - share) * len(y) / max(1, (1 - y).sum()))
    model.coefficients, model.intercept = logistic((f - model.center) / model.scale, y, weight)
    return model


def scored(docs: DataFrame, model: Model | None, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of each row with its score as ``name``; without a model every score is 0."""
    columns = docs.select(*keep, *(["text"] * ("text" not in keep)))
    if model is None:
        return columns.select(*keep, F.lit(0.0).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, step_bytes=TEXT_BYTES):
            score = shared.value.scores(shared.value.features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, name])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in columns.schema if f.name in keep) + f"`{name}` double"
    return columns.mapInArrow(run, schema)


def learnable() -> Column:
    """Rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return crc_remainder("doc_id", 3) != 1


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row.

    Null and empty texts are scored as texts without words; ids that are null are not held out. Each row is
    scored on its own. Other columns are left out, and never looked at.
    """
    rows = scored(docs, fit(docs, labels, learnable()), ["doc_id"])
    return rows.select(
        "doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score under the threshold.

    Null and empty texts count as texts without words, and repeated rows stay or go together; an empty table gives none.
    """
    name = free_name(docs)
    return scored(docs, fit(docs, labels, learnable()), docs.columns, name).where(F.col(name) < threshold).drop(name)
