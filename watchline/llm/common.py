"""Words, hashes and staging shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 4 << 20

#: Odd multipliers of the positional n-gram hash, from a fixed generator.
MULTIPLIERS = np.random.default_rng(20240101).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder that the cluster names; a temporary one only where driver and tasks are one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "watchline-checkpoints"))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, for tables that queries write between stages."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame) -> str:
    """A column name that clashes with none of ``df``."""
    return "_" + "_".join(df.columns)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most ``step_bytes`` of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        step = np.cumsum(size) // step_bytes
        cuts = np.flatnonzero(np.diff(step)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(start, end - start)
    pa.default_memory_pool().release_unused()  # workers are kept for other operators


def texts(column: pa.Array) -> pa.Array:
    """Texts with empty strings for nulls, in 64-bit offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def mapped_bytes(column: pa.Array, mapping: bytes) -> pa.Array:
    """Each byte of the texts replaced by its entry in ``mapping`` (ASCII only may change)."""
    column = pa.concat_arrays([column])  # drops a slice's offset
    _, offsets, values = column.buffers()
    data = (values.to_pybytes() if values else b"").translate(mapping)
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, offsets, pa.py_buffer(data)])


def words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's first word (n + 1), and all words; words lie between ASCII white space."""
    lists = pc.ascii_split_whitespace(column)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    parents = np.repeat(np.arange(len(column)), np.diff(lists.offsets.to_numpy()))
    counts = np.bincount(parents[full], minlength=len(column))
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), flat.filter(pa.array(full))


def coded(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A code for each word, and the distinct words by code."""
    if not len(flat):
        return np.empty(0, np.int64), []
    encoded = pc.dictionary_encode(flat)
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()


def word_hashes(distinct: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.encode()) for w in distinct), np.uint64, len(distinct))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that high and low bits are equally good."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by the run's first word (those over text ends too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * MULTIPLIERS[j % 256]
    return mixed(total)


def gram_hashes_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The same hashes, of the runs that begin at ``at`` only."""
    total = np.full(len(at), np.uint64(k), np.uint64)
    for j in range(k):
        total += hashes[at + j] * MULTIPLIERS[j % 256]
    return mixed(total)


def inside(offsets: np.ndarray, k: int) -> np.ndarray:
    """For each word, whether the run of k words from it ends within its own text."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(len(ends)) + k <= ends


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def winnowed(hashes: np.ndarray, offsets: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are least in some window of ``width`` k-grams of one text.

    Every run of k + width - 1 words holds at least one of them, and equal runs hold equal ones.
    """
    grams = gram_hashes(hashes, k)
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = sliding(grams, width, np.minimum)
    whole = inside(offsets, k + width - 1)[:n]
    least = np.where(whole, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = (sliding(padded, width, np.maximum)[: len(grams)] == grams) & inside(offsets, k)[: len(grams)]
    at = np.flatnonzero(chosen)
    return at, grams[at]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """For n words, whether a run of ``width`` words from one of ``starts`` covers each."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:n]) > 0


def crc_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; the remainder that splits learning from held-out rows."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
