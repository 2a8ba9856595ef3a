"""Language-model scoring by a log-bilinear model.

Frequent words have vectors of their own, and the more of them the more distinct words there are; the others
share one unit for each class of words that end alike, and follow their counts within it. A word's probability
has two factors: that of its class after the two units before it, and that of its unit within the class. Both
are log-bilinear, the product of the context's summed vectors with a class's or a unit's vector, and both are
divided by exact sums, over all classes and over the class's units, so that probabilities add up to 1.

Noise-contrastive estimation trains it in a few rounds, each over another slice of the documents. A slice is
dealt into shards by hashes of its rows, every shard is learnt from in a fixed order from the last round's
model, and the shards' models are averaged by how much each has learnt of every number. Shards depend on the
rows alone, not on how they are partitioned, so neither do the scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchline.llm.common import coded, crc_remainder, mapped_bytes, staged, steps, texts, words
from watchline.llm.near_dups import LOWER

#: Words with vectors of their own are so many times the square root of the distinct words, and classes so many
#: times that of the former.
OWN_FACTOR, CLASS_FACTOR, LEAST_OWN = 2.0, 3.0, 256
WIDTH, CLASS_NOISE, UNIT_NOISE, STEP, BATCH, SEED = 12, 24, 1, 0.2, 4096, 11
#: What the squares of the gradients are taken to add up to before the first step.
FIRST_SQUARES = 1e-8
#: Rounds, and tokens of a shard in the smallest corpus that has more than one; shards grow with the fourth root.
ROUNDS, SHARD_TOKENS = 4, 1 << 18
#: Numbers of the model in one row when shards are averaged.
BLOCK = 1 << 14
#: Words whose counts every task holds at most, the most frequent ones; others' counts are joined.
HELD_WORDS = 200_000
#: Bytes of text whose words are counted together before they are shuffled, and of a step of scoring.
COUNT_BYTES, TEXT_BYTES = 32 << 20, 2 << 20
#: Tokens whose class probabilities are computed at once.
TOKENS_AT_ONCE = 8192
END = ""


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets of each text's tokens, their codes, and the distinct tokens; every text ends with END, code 0."""
    offsets, flat = words(mapped_bytes(texts(column), LOWER))
    codes, distinct = coded(flat)
    n = np.diff(offsets)
    ends = np.cumsum(n + 1) - 1
    out = np.zeros(len(codes) + len(n), np.int64)
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body] = codes + 1
    return np.concatenate([[0], ends + 1]), out, [END, *distinct]


def learnt(docs: DataFrame) -> DataFrame:
    return docs.where(crc_remainder("doc_id", 7) != 2)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` over the tokens of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def combined() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])
            held.clear()
            yield from table.combine_chunks().to_batches(max_chunksize=100_000)

        for batch in steps(batches):
            _, codes, distinct = tokens(batch.column("text"))
            held.append(pa.table({"word": pa.array(distinct, pa.string()), "c": np.bincount(codes, minlength=len(distinct))}))
            size += batch.nbytes
            if size >= COUNT_BYTES:
                yield from combined()
                size = 0
        if held:
            yield from combined()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


class Vocabulary:
    """Counts of the frequent words, and units by class: the class's other words first, then its own words."""

    def __init__(self, rows: list[tuple[str, int]], n: int, v: int, own: int, classes: int, totals: dict[int, tuple[int, int]]) -> None:
        """``rows``: frequent words, of which the first ``own`` have units; ``totals``: tokens and words by class."""
        self.place = {w: i for i, (w, _) in enumerate(rows)}
        self.count = np.array([c for _, c in rows], float)
        self.n, self.v, self.classes = n, v, classes
        self.base_total = np.log10(n + v + 1)
        own_class = np.array([self.class_of(w) for w, _ in rows[:own]], np.int64)
        order = np.lexsort((np.arange(own), own_class))
        size = np.bincount(own_class, minlength=classes) + 1
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.class_of_unit = np.repeat(np.arange(classes), size)
        self.units = int(self.start[-1])
        #: Unit of each word of its own, by place.
        self.own_unit = np.empty(own, np.int64)
        self.own_unit[order] = np.arange(own) + own_class[order] + 1
        rest = np.array([totals.get(g, (0, 0)) for g in range(classes)], float).reshape(classes, 2)
        seen = (self.count[:own] > 0).astype(float)
        rest[:, 0] -= np.bincount(own_class, self.count[:own], classes)
        rest[:, 1] -= np.bincount(own_class, seen, classes)
        #: What a word of no unit of its own divides its count and one by, by class, as a logarithm.
        self.log_rest = np.log10(rest.sum(1) + 1)
        weight = np.ones(self.units)
        weight[self.start[:-1]] += rest[:, 0]
        weight[self.own_unit] += self.count[:own]
        by_class = np.bincount(self.class_of_unit, weight, classes)
        self.class_share = by_class / by_class.sum()
        self.unit_share = weight / by_class[self.class_of_unit]
        self.end = int(self.own_unit[self.place[END]])

    def class_of(self, word: str) -> int:
        return zlib.crc32(word[-2:].encode()) % self.classes

    def units_of(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent words (-1: none) and unit of each word."""
        place = np.fromiter((self.place.get(w, -1) for w in distinct), np.int64, len(distinct))
        own = len(self.own_unit)
        found = [int(self.own_unit[p]) if 0 <= p < own else int(self.start[self.class_of(w)]) for p, w in zip(place, distinct, strict=True)]
        return place, np.array(found, np.int64)


class Vectors:
    """The model: vectors of units one and two tokens before, of units and classes to come, and the biases of these."""

    def __init__(self, vocabulary: Vocabulary, values: np.ndarray) -> None:
        units, classes = vocabulary.units, vocabulary.classes
        self.values = values.astype(np.float32)
        at = 0
        parts = []
        for rows, width in [(units, WIDTH)] * 3 + [(classes, WIDTH), (units, 1), (classes, 1)]:
            part = self.values[at : at + rows * width]
            parts.append(part.reshape(rows, width) if width > 1 else part)
            at += rows * width
        self.near, self.far, self.unit, self.of_class, self.unit_bias, self.class_bias = parts
        self.start, self.class_of_unit = vocabulary.start, vocabulary.class_of_unit

    @classmethod
    def first(cls, vocabulary: Vocabulary) -> Vectors:
        """Small vectors and the biases that make the shares of the counts."""
        small = np.random.default_rng(SEED).normal(0, 0.1, (3 * vocabulary.units + vocabulary.classes) * WIDTH)
        return cls(vocabulary, np.concatenate([small, np.log(vocabulary.unit_share), np.log(vocabulary.class_share)]))

    def log10_probabilities(self, near: np.ndarray, far: np.ndarray, then: np.ndarray) -> np.ndarray:
        """Of the unit ``then`` after ``near`` and, before that, ``far``."""
        # Sums over all classes are computed once for each context; few of a step's tokens have one of their own.
        context, which = np.unique(near * len(self.near) + far, return_inverse=True)
        query = self.near[context // len(self.near)] + self.far[context % len(self.near)]
        total = np.empty(len(context), np.float32)
        for a in range(0, len(context), TOKENS_AT_ONCE):
            b = a + TOKENS_AT_ONCE
            total[a:b] = log_sums(query[a:b] @ self.of_class.T + self.class_bias)
        query, cls = query[which], self.class_of_unit[then]
        out = (np.einsum("ij,ij->i", query, self.of_class[cls]) + self.class_bias[cls] - total[which]).astype(float)
        out += np.einsum("ij,ij->i", query, self.unit[then]) + self.unit_bias[then]
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(len(self.class_bias) + 1))
        for g in np.flatnonzero(np.diff(bounds)):
            low, high = self.start[g], self.start[g + 1]
            for a in range(bounds[g], bounds[g + 1], TOKENS_AT_ONCE):
                at = order[a : min(a + TOKENS_AT_ONCE, bounds[g + 1])]
                out[at] -= log_sums(query[at] @ self.unit[low:high].T + self.unit_bias[low:high])
        return out / np.log(10)


def log_sums(scores: np.ndarray) -> np.ndarray:
    """Natural logs of the sums of each row's exponentials."""
    with np.errstate(over="ignore", divide="ignore"):
        out = np.log(np.exp(scores).sum(1))
    if not np.isfinite(out).all():  # out of the range of short floats
        top = scores.max(1, keepdims=True)
        out = top[:, 0] + np.log(np.exp(scores - top).sum(1))
    return out


def contexts(units: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Units one and two tokens before each token; before a text's start stands the end's unit."""
    near = np.concatenate([[end], units[:-1]])
    far = np.concatenate([[end, end], units[:-2]])[: len(units)]
    starts = offsets[:-1]
    near[starts] = end
    far[starts] = end
    second = starts[np.diff(offsets) > 1] + 1
    far[second] = end
    return near, far


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Trainer:
    """Noise-contrastive estimation with adaptive steps, on one shard from a given model and squares.

    The noise of classes is shared by a batch's tokens; every token has its own noise from the units of its class.
    """

    def __init__(self, vocabulary: Vocabulary, values: np.ndarray, squares: np.ndarray, seed: int) -> None:
        self.vocabulary = vocabulary
        self.model, self.squares = Vectors(vocabulary, values.copy()), Vectors(vocabulary, squares.copy())
        self.class_noise = np.log(CLASS_NOISE * vocabulary.class_share).astype(np.float32)
        self.unit_noise = np.log(UNIT_NOISE * vocabulary.unit_share).astype(np.float32)
        self.class_sums = np.cumsum(vocabulary.class_share)
        # Unit noise: a class's units lie between its place and the next whole number.
        self.unit_sums = np.concatenate([np.cumsum(vocabulary.unit_share[a:b]) + g for g, (a, b) in enumerate(zip(vocabulary.start, vocabulary.start[1:], strict=False))])
        self.rng = np.random.default_rng(seed)
        self.waiting: list[np.ndarray] = [np.empty((3, 0), np.int64)]

    def learn(self, near: np.ndarray, far: np.ndarray, then: np.ndarray, last: bool = False) -> None:
        """Batches have BATCH tokens each, wherever texts end; those left over wait for more unless this is the last."""
        self.waiting.append(np.stack([near, far, then]))
        if last or sum(x.shape[1] for x in self.waiting) >= BATCH:
            ready = np.concatenate(self.waiting, 1)
            whole = ready.shape[1] if last else ready.shape[1] // BATCH * BATCH
            for a in range(0, whole, BATCH):
                self._batch(*ready[:, a : min(a + BATCH, whole)])
            self.waiting = [ready[:, whole:]]

    def _batch(self, near: np.ndarray, far: np.ndarray, then: np.ndarray) -> None:
        m, v, n = self.model, self.vocabulary, len(then)
        query = m.near[near] + m.far[far]
        cls = v.class_of_unit[then]
        noise = np.minimum(np.searchsorted(self.class_sums, self.rng.random(CLASS_NOISE), side="right"), v.classes - 1)
        target, false = m.of_class[cls], m.of_class[noise]
        real_class = 1 - sigmoid(np.einsum("ij,ij->i", query, target) + m.class_bias[cls] - self.class_noise[cls])
        false_class = -sigmoid(query @ false.T + m.class_bias[noise] - self.class_noise[noise])
        d_query = real_class[:, None] * target + false_class @ false
        units, pulls = [then], [1 - sigmoid(np.einsum("ij,ij->i", query, m.unit[then]) + m.unit_bias[then] - self.unit_noise[then])]
        for _ in range(UNIT_NOISE):
            other = np.searchsorted(self.unit_sums, cls + self.rng.random(n), side="right")
            other = np.clip(other, v.start[cls], v.start[cls + 1] - 1)
            units.append(other)
            pulls.append(-sigmoid(np.einsum("ij,ij->i", query, m.unit[other]) + m.unit_bias[other] - self.unit_noise[other]))
        for at, pull in zip(units, pulls, strict=True):
            d_query += pull[:, None] * m.unit[at]
        d_unit = np.concatenate([pull[:, None] * query for pull in pulls])
        self._step("near", None, near, d_query, None, n)
        self._step("far", None, far, d_query, None, n)
        self._step("unit", "unit_bias", np.concatenate(units), d_unit, np.concatenate(pulls), n)
        at = np.concatenate([cls, noise])
        self._step("of_class", "class_bias", at, np.concatenate([real_class[:, None] * query, false_class.T @ query]), np.concatenate([real_class, false_class.sum(0)]), n)

    def _step(self, vectors: str, bias: str | None, at: np.ndarray, d_vectors: np.ndarray, d_bias: np.ndarray | None, n: int) -> None:
        """Move the rows ``at`` along their summed gradients; only rows that occur are touched."""
        size = len(getattr(self.model, vectors))
        there = np.zeros(size, bool)
        there[at] = True
        rows = np.flatnonzero(there)
        place = np.empty(size, np.int64)
        place[rows] = np.arange(len(rows))
        own = place[at]
        by = (own[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        self._move(vectors, rows, np.bincount(by, d_vectors.ravel(), len(rows) * WIDTH).reshape(-1, WIDTH) / n)
        if bias is not None:
            self._move(bias, rows, np.bincount(own, d_bias, len(rows)) / n)

    def _move(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        gradient = gradient.astype(np.float32)
        values, squares = getattr(self.model, name), getattr(self.squares, name)
        squares[rows] += gradient * gradient
        values[rows] += STEP * gradient / np.sqrt(squares[rows])


def unit_rows(docs: DataFrame, vocabulary, shards: int) -> DataFrame:
    """``shard, place, units`` of each row: its shard, its place in it, and its tokens' units as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            offsets, codes, distinct = tokens(batch.column("text"))
            units = vocabulary.value.units_of(distinct)[1].astype("<i4")[codes]
            packed = [units[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("place"), pa.array(packed, pa.binary())], names=["shard", "place", "units"])

    place = F.xxhash64("doc_id", "text")
    shard = F.pmod(F.shiftright(place, 16), F.lit(shards)).cast("int")
    return docs.select("text", place.alias("place"), shard.alias("shard")).mapInArrow(run, "shard int, place long, units binary")


def added(group: pa.Table, keys: list[str]) -> pa.Table:
    """The sums of the numbers in ``values`` over a group's rows, in the order of ``part``."""
    parts = np.array(group.column("part").to_pylist())
    rows = [np.frombuffer(x, np.float64) for x in group.column("values").to_pylist()]
    total = np.sum([rows[i] for i in np.argsort(parts, kind="stable")], axis=0)
    out = {k: pa.array(group.column(k).to_pylist()[:1], pa.int32()) for k in keys}
    return pa.table(out | {"part": pa.array([int(parts.min())], pa.int32()), "values": pa.array([total.tobytes()], pa.binary())})


def one_round(rows: DataFrame, shared, vocabulary, shards: int, turn: int) -> dict[int, np.ndarray]:
    """By block of the model's numbers: what all shards moved them by, weighed by their squares, and the squares."""
    lanes = math.isqrt(shards - 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, squares = shared.value
        trainer, shard = None, -1

        def finished() -> Iterator[pa.RecordBatch]:
            none = np.empty(0, np.int64)
            trainer.learn(none, none, none, last=True)
            gained = trainer.squares.values.astype(float) - squares
            moved = gained * (trainer.model.values.astype(float) - values)
            cuts = range(0, len(values), BLOCK)
            packed = [np.concatenate([moved[a : a + BLOCK], gained[a : a + BLOCK]]).tobytes() for a in cuts]
            n = len(packed)
            ints = lambda x: pa.array(np.full(n, x, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), ints(shard % lanes), ints(shard), pa.array(packed, pa.binary())], names=["block", "lane", "part", "values"])

        for batch in batches:
            for own, packed in zip(batch.column("shard").to_pylist(), batch.column("units").to_pylist(), strict=True):
                if own != shard:
                    if trainer is not None:
                        yield from finished()
                    trainer, shard = Trainer(vocabulary.value, values, squares, SEED + 1_000_003 * turn + own), own
                units = np.frombuffer(packed, "<i4").astype(np.int64)
                trainer.learn(*contexts(units, np.array([0, len(units)]), vocabulary.value.end), units)
        if trainer is not None:
            yield from finished()

    # A shard is learnt from as its rows come in, so that none is held whole; all its rows are in one partition.
    sorted_rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "place", "units")
    parts = sorted_rows.mapInArrow(run, "block int, lane int, part int, values binary")
    by_lane = parts.groupBy("block", "lane").applyInArrow(lambda g: added(g, ["block", "lane"]), "block int, lane int, part int, values binary")
    whole = by_lane.groupBy("block").applyInArrow(lambda g: added(g, ["block"]), "block int, part int, values binary")
    return {r.block: np.frombuffer(r["values"], np.float64) for r in whole.select("block", "values").toLocalIterator()}  # as many as the model has numbers


def train(docs: DataFrame, vocabulary: Vocabulary) -> Vectors:
    """One pass over all rows in ROUNDS slices; every round starts from the last one's average."""
    context = docs.sparkSession.sparkContext
    model = Vectors.first(vocabulary)
    squares = np.full(len(model.values), FIRST_SQUARES, np.float32)
    shards = math.ceil(max(1.0, vocabulary.n / ROUNDS / SHARD_TOKENS) ** 0.75)
    known = context.broadcast(vocabulary)
    for turn in range(ROUNDS):
        shared = context.broadcast((model.values, squares))
        slice_ = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn)
        found = one_round(unit_rows(slice_, known, shards), shared, known, shards, turn)
        if found:
            moved, gained = (np.concatenate([np.split(found[i], 2)[half] for i in range(len(found))]) for half in range(2))
            step = np.divide(moved, gained, out=np.zeros_like(moved), where=gained > 0)
            model = Vectors(vocabulary, model.values + step)
            squares = (squares + gained / shards).astype(np.float32)
        shared.unpersist()
    return model


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The vocabulary of staged counts: frequent words (HELD_WORDS at most), and totals."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Counts in steps of an eighth of a doubling: the least step that leaves HELD_WORDS words at most.
    step = F.floor(8 * F.log2("c"))
    sizes = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, least = 0, None
    for at, n in sizes:
        held += n
        if held > HELD_WORDS:
            break
        least = at
    rows = counts.where(step >= least).toPandas() if least is not None else counts.limit(0).toPandas()
    ends = counts.where(F.col("word") == END).first()
    listed = sorted(((w, c) for w, c in zip(rows["word"], rows["c"].astype(int), strict=True) if w != END), key=lambda x: (-x[1], x[0]))
    listed.insert(0, (END, int(ends.c) if ends else 0))  # the end always has a unit of its own
    own = min(len(listed), max(LEAST_OWN, math.ceil(OWN_FACTOR * math.sqrt(total.v))))
    classes = max(16, math.ceil(CLASS_FACTOR * math.sqrt(own)))
    ending = F.crc32(F.expr("right(word, 2)").cast("binary")) % classes
    totals = {int(r.e): (r.c, r.v) for r in counts.groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    return Vocabulary(listed, int(total.n), int(total.v), own, classes, totals)


def lm_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Both scores are sums of log10 probabilities over a text's tokens and its end. Null texts count as empty.
    Rows without an id are scored, and neither held out nor learnt from. Repeated rows come back as often as
    they are there. If there is nothing to learn from, all words are unknown. Other columns are left out.
    """
    base = docs.select("doc_id", "text")
    counts = staged(word_counts(learnt(base)))
    vocabulary = vocabulary_of(counts)
    model = train(learnt(base), vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what the frequent words give, and one for each other word in it."""
        known, values = shared.value
        vectors = Vectors(known, values)
        own = len(known.own_unit)
        log_count = np.log10(known.count + 1)
        for batch in steps(batches, step_bytes=TEXT_BYTES):
            n = batch.num_rows
            offsets, codes, distinct = tokens(batch.column("text"))
            place, word_unit = known.units_of(distinct)
            units = word_unit[codes]
            token = vectors.log10_probabilities(*contexts(units, offsets, known.end), units)
            at = place[codes]
            shares = (at < 0) | (at >= own)
            token -= np.where(shares, known.log_rest[vectors.class_of_unit[units]], 0.0)
            owner = np.repeat(np.arange(n), np.diff(offsets))
            held = at >= 0
            counted = np.where(held, log_count[np.maximum(at, 0)], 0.0)
            score = token + np.where(shares, counted, 0.0)
            size = max(1, len(distinct))
            pairs, times = np.unique(owner[~held] * size + codes[~held], return_counts=True)
            row = pa.array(np.concatenate([np.arange(n), pairs // size]))
            empty = len(pairs)
            pad = lambda values, kind: pa.array(np.concatenate([np.asarray(values, kind), np.zeros(empty, kind)]))
            word = pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(distinct, pa.string()).take(pa.array(pairs % size))])
            # Rows of one id are told apart by 128 bits of their texts; those that are equal in both score alike.
            digests = pa.array([xxhash.xxh3_128_digest((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(row), digests.take(row), word,
                    pa.array(np.concatenate([np.zeros(n, np.int32), times.astype(np.int32)])),
                    pad(np.diff(offsets), np.int64), pad(np.bincount(owner, held & (known.count[np.maximum(at, 0)] > 0), n), np.int64),
                    pad(np.bincount(owner, counted, n), float), pad(np.bincount(owner, score, n), float),
                ],
                names=["doc_id", "th", "word", "times", "n_tokens", "n_known", "base", "score"],
            )

    schema = "doc_id long, th binary, word string, times int, n_tokens long, n_known long, base double, score double"
    rows = base.mapInArrow(run, schema)
    # A text's own row goes through the join as well, under a key with a space, which no word has; the texts are
    # read once, and such keys are spread.
    found = rows.withColumn("key", F.coalesce("word", F.format_string(" %d", F.xxhash64("doc_id", "th")))).join(counts.withColumnRenamed("word", "key"), "key", "left")
    more = F.when(F.col("c").isNotNull(), F.col("times") * F.log10(F.col("c") + 1)).otherwise(0.0)
    sums = found.groupBy("doc_id", "th").agg(
        F.count_if(F.col("word").isNull()).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + more).alias("base"),
        F.sum(F.col("score") + more).alias("score"),
    )
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    each = lambda c: F.expr(f"{c} div copies")
    return sums.select(
        "doc_id",
        F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out"),
        each("n_tokens").alias("n_tokens"),
        each("n_known").alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        ((F.col("base") - F.col("n_tokens") * float(vocabulary.base_total)) / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
        one.alias("copy"),
    ).drop("copy")
