"""Substring dedup by seed and extend.

Seeds are winnowed anchors: k-grams of words that are least in some window of k-grams, so that every run of
``width`` words holds one, and equal runs hold equal ones. Documents are joined on the anchors; around each
anchor that another document has too, all runs of ``width`` words holding it are looked up under their own
hash. Runs that also start in a document of smaller id are joined to maximal repeats, whose words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchline.llm.common import coded, covered, gram_hashes_at, inside, steps, texts, winnowed, word_hashes, words

#: Words of an anchor; an anchor comes about every (width - ANCHOR + 2) / 2 words.
ANCHOR = 12


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts' words, and the words' hashes."""
    offsets, flat = words(texts(column))
    codes, distinct = coded(flat)
    return offsets, word_hashes(distinct)[codes] if len(codes) else np.empty(0, np.uint64)


def owners(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, side="right") - 1


def anchors(docs: DataFrame, width: int) -> DataFrame:
    """``anchor, id, th, at`` of every anchor; ``at`` counts words from the text's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            offsets, hashes = hashed(batch.column("text"))
            at, grams = winnowed(hashes, offsets, ANCHOR, width - ANCHOR + 1)
            row = owners(at, offsets)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), batch.column("id").take(take), batch.column("th").take(take), pa.array((at - offsets[row]).astype(np.int32))],
                names=["anchor", "id", "th", "at"],
            )

    return docs.mapInArrow(run, "anchor long, id long, th long, at int")


def flat_places(lists: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """Places counted over all texts, from a list of places in each text."""
    lists = pa.concat_arrays([lists])
    counts = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(offsets[:-1], counts)


def windows(docs: DataFrame, width: int) -> DataFrame:
    """``run, id, th, start`` of all runs of ``width`` words that hold an anchor of the column ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            offsets, hashes = hashed(batch.column("text"))
            at = flat_places(batch.column("places"), offsets)
            low = np.maximum(at + ANCHOR - width, offsets[owners(at, offsets)])
            change = np.zeros(len(hashes) + 2, np.int64)
            np.add.at(change, low, 1)
            np.add.at(change, at + 1, -1)
            near = np.flatnonzero((np.cumsum(change)[: len(hashes)] > 0) & inside(offsets, width))
            row = owners(near, offsets)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram_hashes_at(hashes, near, width).view(np.int64)), batch.column("id").take(take), batch.column("th").take(take), pa.array((near - offsets[row]).astype(np.int32))],
                names=["run", "id", "th", "start"],
            )

    return docs.mapInArrow(run, "run long, id long, th long, start int")


def cleaned(docs: DataFrame, width: int, with_text: bool) -> DataFrame:
    """The result rows, from documents with the starts of their repeated runs in ``starts`` (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            column = texts(batch.column("text"))
            offsets, flat = words(column)
            at = flat_places(batch.column("starts").fill_null(pa.scalar([], pa.list_(pa.int32()))), offsets)
            gone = covered(at, width, len(flat))
            n_removed = np.concatenate([[0], np.cumsum(gone)])
            n_removed = n_removed[offsets[1:]] - n_removed[offsets[:-1]]
            n_words = np.diff(offsets)
            kept = flat.filter(pa.array(~gone))
            bounds = np.concatenate([[0], np.cumsum(n_words - n_removed)])
            joined = [" ".join(kept.slice(a, b - a).to_pylist()) for a, b in zip(bounds, bounds[1:], strict=False)]
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in joined])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(joined, pa.string())] * with_text, names=names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def dedup(docs: DataFrame, width: int = 50, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row; with_text adds ``kept_text``.

    A word goes if a run of ``width`` words over it also starts in a document of smaller id. Null texts have no
    words. Rows of one id never remove each other's words; rows without an id remove nothing and lose nothing.
    Repeated rows come back as often as they are there. Other columns are left out.
    """
    # Keys that are never null, so that both joins read one shuffle of the texts; th tells rows of one id apart.
    base = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text", F.isnull("doc_id")).alias("th"))
    found = anchors(base.where("doc_id IS NOT NULL"), width)
    shared = found.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("anchor")
    places = found.join(shared, "anchor").groupBy("id", "th").agg(F.collect_set("at").alias("places"))
    near = windows(base.join(places, ["id", "th"]), width)
    first = near.groupBy("run").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("run", "least")
    starts = near.join(first, "run").where("id > least").groupBy("id", "th").agg(F.collect_set("start").alias("starts"))
    return cleaned(base.join(starts, ["id", "th"], "left"), width, with_text)
