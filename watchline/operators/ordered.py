"""Folds over rows in order whose state is a small object: a key's rows are streamed, never gathered.

Rows are dealt by key and sorted on Spark; a task reads its sorted rows batch by batch and hands the key's state
from each step to the next, so that it holds one batch, the step under way and one key's state. A key's history is
cut wherever a gap ends whatever the state holds, and its stretches are dealt to tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The column that numbers a key's stretches from 0.
STRETCH = "_stretch"
#: Rows that a task hands on at a time.
WRITTEN = 5000
#: Rows of many stretches that ``together`` holds at a time; a single step may have more.
BLOCK = 200_000


def stretches(df: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """``df`` with the number of each row's stretch: one begins where ``at`` is over ``gap`` beyond the row before."""
    w = Window.partitionBy(*keys).orderBy(at)
    cut = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_cut", cut).withColumn(STRETCH, F.sum("_cut").over(w)).drop("_cut")


def folded(df: DataFrame, keys: list[str], step: str, values: list[str], order: list[str], gap: float | None, begin: Callable[[int], Callable], schema: str) -> DataFrame:
    """What the steps of each key give, a step being the rows of one ``step`` value, in ``order`` within it.

    ``begin(stretch)`` gives the function that takes a step's value and rows (tuples of ``values``), and keeps the state:
    a new one for each key and, where ``gap`` is given, for each stretch. It returns tuples of ``schema``, to which the
    key and its stretch are added; after the last step it is called with two None. Rows without a step are left out.
    """
    spark = df.sparkSession
    rows = df.where(F.col(step).isNotNull())
    rows = rows.withColumn(STRETCH, F.lit(0).cast("long")) if gap is None else stretches(rows, keys, step, gap)
    group = [*keys, STRETCH]
    g = len(group)
    full = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), f"{STRETCH} long", schema])
    arrow = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        sorted_rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, own in groupby(sorted_rows, key=lambda r: r[:g]):
            take = begin(key[-1])
            for at, some in groupby(own, key=lambda r: r[g]):
                held += [(*key, *out) for out in take(at, [r[g + 1 :] for r in some])]
                if len(held) >= WRITTEN:
                    yield written(held)
                    held = []
            held += [(*key, *out) for out in take(None, None)]
        if held:
            yield written(held)

    def written(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    # As many partitions as the session asks for: the rows are few beside the work on each.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group).sortWithinPartitions(*group, step, *order)
    return dealt.select(*group, step, *values).mapInArrow(run, full)


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns; the first one does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        codes = c.dictionary_encode("encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def joined(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)]


def together(df: DataFrame, keys: list[str], step: str, values: list[str], order: list[str], gap: float | None, begin: Callable[[], object], schema: str, followed: bool = False) -> DataFrame:
    """What the steps of each key give, as ``folded`` does, with the stretches of a block of rows taken side by side.

    A task reads its sorted rows block by block. All stretches of a block take their first step at once, then their second
    one, and so on, so that array functions work on all of them; only a block's last stretch goes on in the next block.
    ``begin()`` gives the state of a task: ``open(stretches)`` adds lanes, numbered on from those there are; ``step(lanes, at,
    lane, rows)`` takes one step of the ``lanes`` (ascending) with its value and rows (``lane`` of each, and Arrow arrays of
    ``values``); ``end(lanes)`` ends lanes; both yield lists of a lane array and arrays of ``schema``. ``keep(lane)`` makes it the only one.
    With ``followed`` a key's last stretch is left out.
    """
    spark = df.sparkSession
    rows = df.where(F.col(step).isNotNull())
    rows = rows.withColumn(STRETCH, F.lit(0).cast("long")) if gap is None else stretches(rows, keys, step, gap)
    if followed:
        rows = rows.withColumn("_end", F.max(STRETCH).over(Window.partitionBy(*keys))).where(F.col(STRETCH) < F.col("_end"))
    group, size = [*keys, STRETCH], BLOCK
    g = len(group)
    full = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), f"{STRETCH} long", schema])
    arrow = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, names = begin(), None

        def written(found: list) -> Iterator[pa.RecordBatch]:
            lane, *columns = found
            for k in range(0, len(lane), size):
                own = [c.take(pa.array(lane[k : k + size])) for c in names]
                more = [c.slice(k, size) if isinstance(c, pa.Array) else pa.array(c[k : k + size], f.type) for c, f in zip(columns, list(arrow)[g:], strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *more], schema=arrow)

        def block(rows: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            nonlocal names
            new = changes(rows[:g])
            first = np.flatnonzero(new)
            fresh = [c.take(pa.array(first)) for c in rows[:g]]
            begun = 0 if names is None else 1
            goes_on = begun and all(a[0].as_py() == b[0].as_py() for a, b in zip(names, fresh, strict=True))
            if goes_on:
                fresh = [c.slice(1) for c in fresh]
            state.open(fresh[-1].to_numpy())
            names = fresh if names is None else [pa.concat_arrays([a, b]) for a, b in zip(names, fresh, strict=True)]
            lane = np.cumsum(new) - 1 + (begun and not goes_on)
            steps = np.cumsum(new | changes(rows[g : g + 1])) - 1
            place = steps - steps[first][np.cumsum(new) - 1]
            by_place = np.argsort(place, kind="stable")
            bounds = np.searchsorted(place[by_place], np.arange(place.max() + 2))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                some = by_place[a:b]
                taken = pa.array(some)
                lanes, at = np.unique(lane[some], return_index=True)
                own = [c.take(taken) for c in rows[g:]]
                for found in state.step(lanes, own[0].to_numpy(zero_copy_only=False)[at], lane[some], own[1:]):
                    yield from written(found)
            last = len(names[0]) - 1
            for found in state.end(np.arange(last)):
                yield from written(found)
            state.keep(last)
            names = [c.slice(last) for c in names]

        held, n, least = [], 0, size
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < least:
                continue
            rows = joined(held)
            # The last step may go on in the next batch.
            cut = int(np.flatnonzero(changes(rows[: g + 1]))[-1])
            if cut:
                yield from block([c.slice(0, cut) for c in rows])
                rows = [c.slice(cut) for c in rows]
            held, n = [pa.RecordBatch.from_arrays(rows, schema=batch.schema)], len(rows[0])
            least = max(size, 2 * n)
        if n:
            yield from block(joined(held))
        if names is not None:
            for found in state.end(np.arange(1)):
                yield from written(found)

    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group).sortWithinPartitions(*group, step, *order)
    return dealt.select(*group, step, *values).mapInArrow(run, full)
