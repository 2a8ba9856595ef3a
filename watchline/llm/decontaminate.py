"""Benchmark decontamination by winnowing.

Of the k-grams of a text, those that are least in some window are its fingerprints; any run of k + w - 1
words holds one. The fingerprints of documents and of benchmark items are tables, joined on Spark; every joined
pair is extended word by word to both sides, and is a hit if the run is as long as a window. Items of fewer
words than a window have one fingerprint, the whole of them.

A bitmap of the items' fingerprints, of bounded size, spares the join most fingerprints that no item has; it
lets through all that some item has, whatever the size of the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchline.llm.common import coded, free_name, gram_hashes, inside, mapped_bytes, mixed, staged, steps, texts, winnowed, word_hashes, words

#: Bits of the bitmap, as powers of two: at least, and at most (16 MB).
LEAST_BITS, MOST_BITS = 16, 27
#: Fingerprints of items, or digests of texts, that a broadcast may hold; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Fixed value: separators are ASCII other than letters and digits; letters are lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class Bitmap:
    """Which leading ``bits`` bits occur among some 64-bit hashes; ``parts`` are its words of 64 bits by place."""

    def __init__(self, bits: int, parts: list[tuple[int, int]]) -> None:
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), np.int64)
        self.words[[at for at, _ in parts]] = [value for _, value in parts]
        self.words = self.words.view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def bitmap_of(seeds: DataFrame, n: int) -> Bitmap:
    """A bitmap of the column ``seed`` of n rows; no more than 2^MOST_BITS bits come to the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(n + 1)) + 5))
    place = seeds.select(F.shiftrightunsigned("seed", 64 - bits).alias("place"))
    parts = place.groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("value"))
    return Bitmap(bits, [(r["at"], r["value"]) for r in parts.toLocalIterator()])


def lists(flat: pa.Array, at: np.ndarray, there: np.ndarray) -> pa.Array:
    """A list of words for each row of ``at``, of the places where ``there`` holds."""
    offsets = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, flat.take(pa.array(at[there])).cast(pa.string()))


def fingerprints(rows: DataFrame, width: int, k: int, short: list[int] | None = None, bitmap: Bitmap | None = None) -> DataFrame:
    """The fingerprints of ``rows`` (text and other columns): other columns, ``n_words``, ``whole``, ``seed``, ``at``,
    ``core``, ``before`` and ``after``.

    ``core`` are the words of a fingerprint, ``before`` and ``after`` as many of its neighbours, the nearest first,
    as a window holds; ``whole`` tells fingerprints that have none as they stand for a short item. Without ``bitmap``, texts of fewer words than a window are their own fingerprint; with it
    all runs as long as one of ``short`` are, only what the bitmap has comes back, and each row also has a row of
    its own without a fingerprint.
    """
    keep = [c for c in rows.columns if c != "text"]
    reach = width - k
    shared = None if bitmap is None else rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            n = batch.num_rows
            offsets, flat = words(mapped_bytes(texts(batch.column("text")), FOLD))
            counts = np.diff(offsets)
            codes, distinct = coded(flat)
            hashes = word_hashes(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
            found = [(k, True, *winnowed(hashes, offsets, k, reach + 1))]
            for length in sorted({int(c) for c in counts if 0 < c < width}) if short is None else short:
                grams = gram_hashes(hashes, length)
                start = offsets[:-1][counts == length] if short is None else np.flatnonzero(inside(offsets, length)[: len(grams)])
                found.append((length, False, start, mixed(grams[start] + np.uint64(length))))  # apart from other lengths
            if shared is not None:
                no = pa.nulls(n, pa.list_(pa.string()))
                yield from out(batch, np.arange(n), counts, [pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), no, no])
            for length, reaching, at, seeds in found:
                if shared is not None:
                    there = shared.value.has(seeds)
                    at, seeds = at[there], seeds[there]
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, side="right") - 1
                core = pc.binary_join(lists(flat, at[:, None] + np.arange(length), np.ones((len(at), length), bool)), " ")
                steps_out = np.arange(reach if reaching else 0)
                before, after = at[:, None] - 1 - steps_out, at[:, None] + length + steps_out
                sides = [lists(flat, before, before >= offsets[row][:, None]), lists(flat, after, after < offsets[row + 1][:, None])]
                yield from out(batch, row, counts, [pa.array(np.full(len(at), not reaching)), pa.array(seeds.view(np.int64)), pa.array((at - offsets[row]).astype(np.int32)), core, *sides])

    def out(batch: pa.RecordBatch, row: np.ndarray, counts: np.ndarray, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        take = pa.array(row)
        own = [batch.column(c).take(take) for c in keep]
        yield pa.RecordBatch.from_arrays([*own, pa.array(counts[row], pa.int64()), *columns], names=[*keep, "n_words", "whole", "seed", "at", "core", "before", "after"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kept}n_words long, whole boolean, seed long, at int, core string, before array<string>, after array<string>")


def alike(a: str, b: str) -> Column:
    """How many words two lists have in common before they first differ."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def items_of(benchmark: DataFrame, width: int, k: int) -> tuple[DataFrame, Bitmap, list[int], bool]:
    """The items' fingerprints as a staged table, their bitmap, the lengths of short items, and if they are few."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    found = fingerprints(rows, width, k).select("item_id", "whole", "seed", "core", F.col("before").alias("item_before"), F.col("after").alias("item_after"), "n_words")
    found = staged(found.distinct())
    n = found.count()
    short = sorted(r.n_words for r in found.where(F.col("n_words") < width).select("n_words").distinct().collect())  # under width of them
    return found.drop("n_words"), bitmap_of(found, n), short, n <= BROADCAST_ROWS


def hits(docs: DataFrame, benchmark: DataFrame, width: int, k: int) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_words``; a row for each hit with its span ``start, end`` in words
    and ``item_id``, and one without a hit for each row."""
    items, bitmap, short, few = items_of(benchmark, width, k)
    found = fingerprints(docs, width, k, short, bitmap)
    joined = found.join(F.broadcast(items) if few else items, ["seed", "whole", "core"], "left")
    left, right, n = alike("before", "item_before"), alike("after", "item_after"), F.size(F.split("core", " "))
    extended = joined.withColumns({"start": (F.col("at") - left).cast("long"), "end": (F.col("at") + n + right).cast("long")})
    hit = F.col("item_id").isNotNull() & (F.col("whole") | (F.col("end") - F.col("start") >= width))
    return extended.where(F.col("seed").isNull() | hit).select(*(c for c in docs.columns if c != "text"), "n_words", "start", "end", "item_id")


def digest() -> Column:
    """128 bits of the text, by which rows are told apart and contaminated texts are known again."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, k: int = 5) -> DataFrame:
    """Each row of ``docs`` (doc_id) with n_words, its hit ``spans`` in words and the ``items`` that occur in it.

    Null texts have no words; null items, and items without words, match nothing; an item repeated under one
    id counts once. Spans are sorted, and may overlap. Repeated rows come back as often as they are there. Other
    columns, and those that clash with the new names, are left out.
    """
    found = hits(docs.select("doc_id", digest().alias("th"), "text"), benchmark, width, k)
    rows = found.groupBy("doc_id", "th").agg(
        F.count_if(F.col("start").isNull()).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    return rows.select("doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs.

    Null and empty texts stay, repeated rows stay or go together; an empty benchmark rejects nothing.
    """
    name = free_name(docs)
    found = hits(docs.select(digest().alias(name), "text"), benchmark, width, k)
    gone = staged(found.where("item_id IS NOT NULL").select(name).distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.withColumn(name, digest()).join(F.broadcast(gone) if few else gone, name, "left_anti").drop(name)


def union_length(spans: str) -> Column:
    """Words that sorted spans cover, as a column."""
    grown = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
            F.greatest(s["end"], a["end"]).alias("end"),
        ),
    )
    return grown["n"]


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10, k: int = 5) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each row."""
    rows = contamination(docs, benchmark, width, k)
    n_hit = union_length("spans")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
