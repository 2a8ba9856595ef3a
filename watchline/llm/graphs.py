"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchline.llm.common import staged


#: Rows of a small table that one task takes.
TASK_ROWS = 200_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have about so many rows, in as many tasks as they need: few rows make few files."""
    return df.coalesce(1 + rows // TASK_ROWS)


def both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def with_least(ends: DataFrame) -> DataFrame:
    """``u, v`` with the least of u and all its v as ``m``; a node of many links is summed up before the join."""
    least = ends.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return ends.join(least, "u")


def signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links`` (a, b); a component is named by its least node.

    Each pass links larger neighbours to the least one, then smaller ones; when nothing changes, every node
    is linked to its component's least node. Links with a null end, or from a node to itself, say nothing.
    """
    now = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = signature(now)
    while True:
        n = 2 * before[0]
        large = gathered(with_least(both_ways(now)).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")), n)
        down = gathered(with_least(gathered(large.distinct(), n).select(F.col("a").alias("u"), F.col("b").alias("v"))), n)
        small = down.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = staged(gathered(small.where("a <> b").distinct(), n))
        after = signature(now)
        if after == before:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        before = after


def regrouped(groups: DataFrame | None, links: DataFrame, rows: int) -> DataFrame:
    """Groups (node, component) with more links (a, b) between their nodes or others; about ``rows`` in all."""
    if groups is None:
        return staged(gathered(components(links), rows))
    of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    between = gathered(links.join(of("a"), "a", "left").join(of("b"), "b", "left"), rows)
    between = between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = staged(gathered(components(between), rows))
    renamed = groups.join(merged.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    others = merged.join(groups.select("node"), "node", "left_anti")
    return staged(gathered(renamed.select("node", F.coalesce("into", "component").alias("component")).union(others.select("node", "component")), rows))
