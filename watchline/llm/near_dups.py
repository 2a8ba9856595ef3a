"""Near-duplicate groups by HyperMinHash.

The hashes of a document's shingles are dealt over registers; each register keeps the leading zeros of its
least hash and the bits after them. Four registers together are a band. Documents that share a band are
candidates, those whose registers estimate enough similarity (less chance collisions) are confirmed on their
full shingle sets, and links join documents to groups.

Not all pairs of a bucket are compared. In a few rounds every bucket has one document compared with those of
other groups, another document each time; what is then still apart in a bucket is compared with the bucket,
in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchline.llm.common import coded, free_name, gram_hashes, gram_hashes_at, mapped_bytes, staged, steps, texts, word_hashes, words
from watchline.llm.graphs import gathered, regrouped

REGISTERS, BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // BAND
#: Chance that the registers of two unrelated documents agree: equal zeros, one in three, and equal mantissas.
COLLISION = 2.0**-MANTISSA / 3
#: Candidates below this estimate, over five standard errors under the threshold, are not confirmed.
LEAST_ESTIMATE = 0.5
ROUNDS = 2
#: Documents of one block when what is left of a bucket is compared.
BLOCK = 500
#: In buckets of up to so many nodes candidates are confirmed pair by pair.
SMALL = 64
#: Ids that a broadcast may hold; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: For each empty register, the order in which others are tried to fill it.
PROBES = np.stack([np.random.default_rng(i).permutation(REGISTERS) for i in range(REGISTERS)])


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; of fewer words, the whole sequence's."""
    offsets, flat = words(mapped_bytes(texts(column), LOWER))
    codes, distinct = coded(flat)
    hashes = word_hashes(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
    grams = gram_hashes(hashes, k)
    out = []
    for start, end in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        if end - start >= k:
            out.append(np.unique(grams[start : end - k + 1]))
        elif end > start:
            out.append(gram_hashes_at(hashes, np.array([start]), end - start))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set as uint16: six bits of leading zeros, then the mantissa. Empty sets have zeros."""
    bounds = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57)
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    for i, s in enumerate(sets):
        if not len(s):
            continue
        first = np.searchsorted(s, bounds)
        full = first < np.append(first[1:], len(s))
        source = np.arange(REGISTERS)
        if not full.all():
            tried = full[PROBES]
            source = np.where(full, source, PROBES[source, tried.argmax(1)])
        least[i] = s[first[source]]
    rest = least << np.uint64(7)
    _, exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))
    zeros = np.where(rest >> np.uint64(11) == 0, 53, 53 - exponent).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype("<u2")


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, digest, sketch``: the size and digest of each shingle set, and its bands as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = shingle_sets(batch.column("text"), k)
            bands = registers(sets).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(bands.ravel())),
                ],
                names=["doc_id", "n", "digest", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """``node, shingles`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = shingle_sets(batch.column("text"), k)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["node", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, shingles array<long>")


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``ids`` (node); broadcast if there are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join((F.broadcast(ids) if few else ids).withColumnRenamed("node", column), column, "left_semi")


def estimate(a: str, b: str):
    """Jaccard similarity from two sketches: the share of equal registers, less chance collisions."""
    equal = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)),
        F.lit(0),
        lambda n, x: n + sum((F.when(F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0) for i in range(BAND)), F.lit(0)),
    )
    return (equal / REGISTERS - COLLISION) / (1 - COLLISION)


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Those of ``pairs`` (a, b; ``rows`` at most) whose full sets are similar enough, after the estimate."""
    of = lambda end: sketches.select(F.col("node").alias(end), F.col("sketch").alias(f"sketch_{end}"))
    both = gathered(pairs.join(of("a"), "a"), 4 * rows).join(of("b"), "b")
    likely = staged(gathered(both.where(estimate("sketch_a", "sketch_b") >= LEAST_ESTIMATE).select("a", "b"), rows))
    ends = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    near = only(sets, staged(gathered(ends, rows)), "node")
    full = lambda end: near.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    found = likely.join(full("a"), "a").join(full("b"), "b").where(100 * shared >= percent * union).select("a", "b")
    return staged(gathered(found.distinct(), rows))


def labelled(buckets: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Buckets with each node's group: its own id if it has none."""
    if groups is None:
        return buckets.withColumn("component", F.col("node"))
    return buckets.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def hub_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """In each bucket of several groups, one node (another one each turn) with all nodes of other groups."""
    hub = (
        rows.groupBy("band", "key")
        .agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), F.col("node").alias("hub"), F.col("component").alias("of"))).alias("h"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("band", "key", "h.hub", "h.of")
    )
    pairs = rows.join(hub, ["band", "key"]).where("component <> of")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def open_buckets(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of buckets that still hold several groups, as blocks to compare.

    The nodes outside a bucket's largest group (``asks``) meet all its nodes: each block of them (``left``) with
    each block of all (``right``). ``large`` tells buckets of more than SMALL nodes.
    """
    size = rows.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    most = size.groupBy("band", "key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("total"), F.count("*").alias("groups")).where("groups > 1")
    most = most.select("band", "key", F.col("most.component").alias("main"), (F.col("total") > SMALL).alias("large"), F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(most, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = staged(placed.join(sketches, "node").select("band", "key", "large", "node", "component", "sketch", "main", "blocks", "block"))
    base = ["band", "key", "large", "node", "component", "sketch"]
    outside = placed.where("component <> main")
    outer = outside.select(*base, F.col("block").alias("left"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("right"), F.lit(True).alias("asks"))
    outers = outside.select("band", "key", F.col("block").alias("left")).distinct()
    inner = placed.withColumnRenamed("block", "right").join(outers, ["band", "key"]).select(*base, "left", "right", F.lit(False).alias("asks"))
    return outer.union(inner)


def candidates(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each asking row of a block with the rows that its sketch finds similar, in another group.

    A pair counts in the first band that it shares, and in no other bucket.
    """
    band = group.column("band")[0].as_py()
    asks = group.column("asks").to_numpy()
    component = group.column("component").to_numpy()
    sketch = pc.list_flatten(group.column("sketch").combine_chunks()).to_numpy().reshape(-1, BANDS)
    lanes = sketch.view("<u2")
    there = np.flatnonzero(~asks)
    for i in np.flatnonzero(asks):
        share = (lanes[there] == lanes[i]).mean(1)
        first = (sketch[there] == sketch[i]).argmax(1)
        found = there[((share - COLLISION) / (1 - COLLISION) >= LEAST_ESTIMATE) & (first == band) & (component[there] != component[i])]
        if len(found):
            yield i, found


def as_links(node: np.ndarray, found: list[tuple[int, np.ndarray]]) -> pa.Table:
    a = [np.minimum(node[at], node[i]) for i, at in found]
    b = [np.maximum(node[at], node[i]) for i, at in found]
    none = [np.empty(0, np.int64)]
    return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})


def small_pairs(blocks: DataFrame) -> DataFrame:
    """Candidate pairs of small buckets, to be confirmed."""

    def compare(group: pa.Table) -> pa.Table:
        return as_links(group.column("node").to_numpy(), list(candidates(group)))

    return blocks.where("NOT large").groupBy("band", "key", "left", "right").applyInArrow(compare, "a long, b long").distinct()


def large_links(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of large buckets: rows bring their full sets along, as a row has many candidates there."""

    def compare(group: pa.Table) -> pa.Table:
        lists = group.column("shingles").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        starts = np.concatenate([[0], np.cumsum(size)])
        values, known = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True)
        links = []
        for i, found in candidates(group):
            mine = np.zeros(len(values), np.int64)
            mine[known[starts[i] : starts[i + 1]]] = 1
            shared = np.add.reduceat(mine[known], starts[:-1])[found]
            links.append((i, found[100 * shared >= percent * (size[found] + size[i] - shared)]))
        return as_links(group.column("node").to_numpy(), links)

    rows = blocks.where("large")
    near = only(sets, staged(rows.select("node").distinct()), "node")
    # Rows are few and comparing them is slow, so that tasks go by number and not by bytes.
    spread = rows.join(near, "node").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band", "key", "left", "right")
    return spread.groupBy("band", "key", "left", "right").applyInArrow(compare, "a long, b long").distinct()


def groups_of(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row.

    Two documents are linked if their sets of k-word shingles (letters A to Z lower-cased) have a Jaccard
    similarity of ``percent`` or more; component_id is the least id reachable over links, and the document of
    that id is kept. Documents without words are linked with nothing. Rows without an id are linked with
    nothing and kept, their component_id null. Rows that share an id count as one document: what is linked
    with one is linked with all. Other columns are left out.
    """
    rows = staged(sketched(docs, k))
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"))
    sketches = staged(classes.select("digest", "node", "sketch"))
    banded = sketches.select("node", F.posexplode("sketch").alias("band", "key"))
    several = banded.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", "key")
    buckets = staged(banded.join(several, ["band", "key"]).select("band", "key", "node").distinct())
    n = buckets.count()
    nodes = staged(gathered(buckets.select("node").distinct(), n))
    sets = staged(full_sets(only(docs.where("doc_id IS NOT NULL"), nodes, "doc_id"), k))
    known = staged(gathered(only(sketches.select("node", "sketch"), nodes, "node"), 4 * n))

    groups = checked = None

    def add(found: DataFrame) -> None:
        nonlocal groups
        if not found.isEmpty():
            groups = regrouped(groups, found, n)

    def unchecked(pairs: DataFrame) -> DataFrame:
        return staged(gathered(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), n))

    for turn in range(ROUNDS):
        pairs = unchecked(hub_pairs(labelled(buckets, groups), turn))
        checked = pairs if checked is None else checked.union(pairs)
        add(confirmed(pairs, known, sets, percent, n))
    blocks = open_buckets(labelled(buckets, groups), known)
    few = confirmed(unchecked(small_pairs(blocks)), known, sets, percent, n)
    add(few.union(staged(gathered(large_links(blocks, sets, percent), n))))

    names = sketches.select("digest", "node")
    names = names.withColumn("component", F.col("node")) if groups is None else names.join(groups, "node", "left")
    named = rows.drop("sketch").join(names, "digest", "left")
    linked = F.col("n") > 0
    component = F.when(linked, F.coalesce("component", "node"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id")))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_dups(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is kept; rows of one id stay or go together.

    Null and empty texts, and rows without an id, are linked with nothing and stay; an empty table gives none.
    """
    name = free_name(docs)
    gone = staged(groups_of(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias(name)).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(name), "left_anti")
