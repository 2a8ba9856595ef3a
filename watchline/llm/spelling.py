"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all its distinct deletions, replacements and insertions over the letters that the
vocabulary has; those that are words are its near words, as a join on the words themselves finds, with no distance
to verify. Candidates are generated as arrays of rolling hashes, and only those that a bitmap of bounded size can't
rule out are written out for the join; the bitmap lets through all that are words, whatever their number.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchline.llm.common import mapped_bytes, mixed, staged, steps, texts
from watchline.llm.decontaminate import Bitmap, bitmap_of

#: A word has so many code points and occurrences at least; one run in DROPPED loses a code point;
#: a form has TIMES the word's occurrences.
LEAST_LENGTH, LEAST_COUNT, DROPPED, TIMES = 5, 3, 97, 2
#: Runs shorter than a word can't become one.
RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Distinct words that a task counts before it passes them on, and candidates that one step makes.
COUNTED, CELLS = 300_000, 1 << 20
#: Places in the bitmap that a word takes.
PROBES = 4

_rng = np.random.default_rng(20240611)
#: A number for each letter (all are under 256), the rolling hash's base and its inverse, and a mark for each probe.
LETTERS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
MARKS = _rng.integers(0, 2**63, PROBES, dtype=np.uint64)


def counts(docs: DataFrame) -> DataFrame:
    """``word, n`` in parts: the words of each task's texts, with the code point dropped that the id and run decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in steps(batches):
            low = mapped_bytes(texts(batch.column("text")), LOWER)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), low.to_pylist(), strict=True):
                begun = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(RUN.findall(text)).items():
                    if doc_id is not None and not (crc := zlib.crc32(word.encode(), begun)) % DROPPED:
                        at = crc % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    found[word] += n
            if len(found) > COUNTED:
                yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})
                found = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words of all texts."""
    return counts(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def powers(length: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, BASE)]), dtype=np.uint64)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and letters (a row each) of the words of one length, in slices of a bounded number of letters."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        size = max(1, CELLS // (64 * length))
        for i in range(0, len(at), size):
            some = at[i : i + size]
            yield some, np.frombuffer("".join(words[k] for k in some).encode("latin-1"), np.uint8).reshape(len(some), length)


def sums(letters: np.ndarray) -> np.ndarray:
    """Rolling hashes of all beginnings of the words, the empty ones included."""
    terms = LETTERS[letters] * powers(letters.shape[1])[:-1]
    return np.concatenate([np.zeros((len(letters), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)


def seeds(words: DataFrame) -> DataFrame:
    """``seed`` for each probe of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters in by_length(batch.column("word").to_pylist()):
                whole = sums(letters)[:, -1]
                yield pa.RecordBatch.from_arrays([pa.array(mixed(whole[:, None] ^ MARKS).ravel().view(np.int64))], names=["seed"])

    return words.select("word").mapInArrow(run, "seed long")


def possible(hashes: np.ndarray, bitmap: Bitmap, valid: np.ndarray) -> np.ndarray:
    """Flat places of the valid candidates that the bitmap has."""
    flat = hashes.ravel()
    at = np.flatnonzero(valid)
    for mark in MARKS:
        at = at[bitmap.has(mixed(flat[at] ^ mark))]
    return at


def edits(letters: np.ndarray, alphabet: np.ndarray, bitmap: Bitmap) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Kind of edit, word (by place), position and letter of all distinct candidates that the bitmap has.

    Of equal deletions the first in a run of one letter counts, and of equal insertions the one behind the run, so
    that no candidate is made twice.
    """
    m, length = letters.shape
    ahead, scale = sums(letters), powers(length)
    whole = ahead[:, -1:]
    own = LETTERS[alphabet]
    again = np.zeros((m, length), bool)
    again[:, 1:] = letters[:, 1:] == letters[:, :-1]
    row, at = np.divmod(possible(ahead[:, :-1] + (whole - ahead[:, 1:]) * BACK, bitmap, ~again), length)
    yield "delete", row, at, np.zeros(len(row), np.int64)
    width = max(1, CELLS // (m * len(alphabet)))
    for low in range(0, length + 1, width):
        places = np.arange(low, min(low + width, length + 1))
        new = own[None, None, :] * scale[places][None, :, None]
        behind = np.concatenate([letters, np.zeros((m, 1), np.uint8)], axis=1)[:, places, None]
        inserted = (ahead[:, places] + (whole - ahead[:, places]) * BASE)[:, :, None] + new
        for kind, hashes in (("insert", inserted), ("replace", None)):
            inner = places
            if kind == "replace":
                inner = places[places < length]
                hashes = (whole - (ahead[:, inner + 1] - ahead[:, inner]))[:, :, None] + new[:, : len(inner)]
            if not len(inner):
                continue
            row, at, letter = np.unravel_index(possible(hashes, bitmap, behind[:, : len(inner)] != alphabet), hashes.shape)
            yield kind, row, inner[at], alphabet[letter].astype(np.int64)


def edited(word: str, kind: str, at: int, letter: int) -> str:
    return word[:at] + (chr(letter) if kind != "delete" else "") + word[at + (kind != "insert") :]


def neighbours(words: DataFrame, letters: list[str], bitmap: Bitmap) -> DataFrame:
    """``word, near``: the candidates of each word, but for those that the bitmap rules out."""
    shared = words.sparkSession.sparkContext.broadcast(bitmap)
    alphabet = np.array(sorted(map(ord, letters)), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("word").to_pylist()
            for places, matrix in by_length(own):
                size = max(1, CELLS // (8 * matrix.shape[1]))  # candidates are written a few megabytes at a time
                for kind, row, at, letter in edits(matrix, alphabet, shared.value):
                    for i in range(0, len(row), size):
                        base = [own[k] for k in places[row[i : i + size]]]
                        made = [edited(w, kind, a, x) for w, a, x in zip(base, at[i : i + size].tolist(), letter[i : i + size].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(base, pa.string()), pa.array(made, pa.string())], names=["word", "near"])

    return words.select("word").mapInArrow(run, "word string, near string")


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` of all pairs of words of the vocabulary ``word, n`` that differ by one edit, both ways."""
    spark = words.sparkSession
    letters = [r[0] for r in words.select(F.explode(F.split("word", "")).alias("letter")).distinct().collect()]  # ninety at most
    bitmap = bitmap_of(seeds(words), PROBES * words.count())
    dealt = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")  # few rows, much work for each
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return neighbours(dealt, letters, bitmap).join(known, "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to the last. Each round doubles the steps of all words."""
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(now.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word.

    A word's form is its near word of most occurrences, if those are twice its own or more; of equally frequent ones
    the first in code-point order. ``root`` follows forms to the last. Null texts have no words; rows without an id
    keep their runs whole; repeated rows count as often as they are there. An empty table has no words, and other
    columns are left out.
    """
    words = staged(vocabulary(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    more = -F.col("best.less")
    found = words.join(near, "word", "left").withColumn("taken", F.coalesce(more >= TIMES * F.col("n"), F.lit(False)))
    found = staged(found.select("word", F.when(F.col("taken"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("taken"), more).alias("form_n")))
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
