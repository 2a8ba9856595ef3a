"""Operators whose state depends on what was emitted before, as folds over each key's ordered rows.

Rows of a key are gathered as small structs of time and sequence and folded in the JVM, in the stretches of a
history between two gaps after which the state starts anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def seconds(ts: Column) -> Column:
    """Seconds since 1970, with microseconds."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def clock(df: DataFrame, at: str) -> Column:
    """A time in seconds, or a number such as a frame's as it is."""
    return F.col(at).cast("double") if isinstance(df.schema[at].dataType, NumericType) else seconds(F.col(at))


def emit_with_cooldown(df: DataFrame, keys: list[str], ts: str, seq: str, cooldown: float, inclusive: bool = True, bypass: Column | None = None) -> DataFrame:
    """Rows that come at least ``cooldown`` seconds (or numbers, such as frames) after the key's last emitted row, or bypass the wait.

    Without ``inclusive``, a row at exactly the cooldown is held back. The last *emitted* row counts, not the
    last seen one, so that ``lag`` alone can't tell. ``seq`` need be unique within a key only.
    """
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    now = clock(df, ts)
    waited = now - F.lag(now).over(w)
    apart = (waited >= cooldown) if inclusive else (waited > cooldown)
    # A row after so long a gap is emitted whatever came before, so that each stretch can be folded by itself.
    rows = df.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.sum(F.when(apart, 1).otherwise(0)).over(w).alias("_stretch"),
        F.struct(now.alias("t"), F.col(seq).alias("s"), F.coalesce(bypass if bypass is not None else F.lit(False), F.lit(False)).alias("b")).alias("_item"),
    )
    named = [f"_k{i}" for i in range(len(keys))]
    grouped = rows.groupBy(*named, "_stretch").agg(F.array_sort(F.collect_list("_item")).alias("rows"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.expr(f"cast(array() as array<{dict(df.dtypes)[seq]}>)").alias("out"))

    def step(state: Column, row: Column) -> Column:
        waited = row["t"] - state["last"]
        due = state["last"].isNull() | row["b"] | ((waited >= cooldown) if inclusive else (waited > cooldown))
        return F.struct(F.when(due, row["t"]).otherwise(state["last"]).alias("last"), F.when(due, F.array_append(state["out"], row["s"])).otherwise(state["out"]).alias("out"))

    emitted = grouped.select(*named, F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("_seq"))
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(emitted[n]) for k, n in zip(keys, named, strict=True)), df[seq] == emitted["_seq"])
    return df.join(emitted, same, "left_semi")


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Each key's last ``n`` rows, with ``place`` 1 for the last one; cut before anything is gathered."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def last_smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """Each key's exponentially smoothed ``value`` after its last row, as ``smoothed``: a weighted sum of its rows.

    The first value weighs all that is left of one; rows without a value are left out.
    """
    back = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(back).alias("_at"), F.lead(F.lit(1)).over(back).alias("_more"))
    weight = F.pow(F.lit(1 - alpha), F.col("_at") - 1) * F.when(F.col("_more").isNotNull(), alpha).otherwise(1.0)
    return rows.groupBy(*keys).agg(F.sum(F.col(value) * weight).alias("smoothed"))


def leaky_alarms(df: DataFrame, keys: list[str], order: list[str], flag: str, limit: int = 3) -> DataFrame:
    """Rows with ``alarm``: whether a counter that rises with a true ``flag`` and falls with a false one, never
    below 0, is at ``limit``. The counter is the running sum less the least it has come to, if that is below 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_sum", F.sum(F.when(F.col(flag), 1).otherwise(-1)).over(w))
    level = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))
    return rows.withColumn("alarm", level >= limit).drop("_sum")


def smoothed(values: Column, alpha: float) -> Column:
    """Exponential smoothing of an array: each value weighs ``alpha``, the smoothed past the rest."""
    start = F.struct(F.lit(None).cast("double").alias("v"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(state: Column, x: Column) -> Column:
        v = F.coalesce(alpha * x + (1 - alpha) * state["v"], x.cast("double"))
        return F.struct(v.alias("v"), F.array_append(state["out"], v).alias("out"))

    return F.aggregate(values, start, step, lambda s: s["out"])


def leaky_alarm(flags: Column, limit: int = 3) -> Column:
    """For each flag of an array, whether a counter that rises with true and falls with false is at ``limit``."""
    start = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<boolean>)").alias("out"))

    def step(state: Column, flag: Column) -> Column:
        n = F.when(flag, state["n"] + 1).otherwise(F.greatest(state["n"] - 1, F.lit(0)))
        return F.struct(n.alias("n"), F.array_append(state["out"], n >= limit).alias("out"))

    return F.aggregate(flags, start, step, lambda s: s["out"])


def majority_vote(votes: Column) -> Column:
    """The most frequent value of an array; of several, the one that comes first in it."""
    counted = F.transform(F.array_distinct(votes), lambda v: F.struct(F.size(F.filter(votes, lambda w: w == v)).alias("n"), (-F.array_position(votes, v)).alias("at"), v.alias("v")))
    return F.array_max(counted)["v"]
