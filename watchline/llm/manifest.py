"""Merkle manifest of a dataset by parent preimages.

Each source's leaves, in order of their ids, make a tree in which every parent is the digest of its children's
digests, written one after the other; the sources' roots make another tree over them. What is kept of a tree is
each parent's preimage, the digests of up to ``FAN`` children. A leaf finds its ancestors' preimages by joins: the
siblings are what is left when its own 64 characters are cut out, and a changed leaf is folded to the root by
putting its digest in their place. Places in order come from a sort by range and one count for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from watchline.llm.common import staged

#: Children of a parent, and characters of a digest.
FAN, DIGEST = 16, 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(text: Column) -> Column:
    """The digest of a row with ``text`` in place of its text: byte count and value of each field, ``-`` for nulls."""
    values = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return h(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values))


def part() -> Column:
    return F.shiftright("at", 33)


def ordered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` staged in ascending order, with ``at``: the partition in the upper bits, the place in it in the lower 33."""
    return staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))


def offsets(runs: DataFrame) -> DataFrame:
    """``p, before``: rows of all earlier partitions, of ``runs`` (p, n). The window has one row for each partition."""
    sizes = runs.groupBy("p").agg(F.sum("n").alias("n"))
    window = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("p", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("before"))


def place() -> Column:
    """The place among all rows, from what ``ordered`` and ``offsets`` give."""
    return F.col("before") + (F.col("at").bitwiseAND((1 << 33) - 1))


def placed_sources(runs: DataFrame) -> DataFrame:
    """``source, tree, first, size``: each source's place among the sources, its first leaf's place, and its leaves."""
    starts = runs.join(offsets(runs), "p").groupBy("source").agg(F.min(F.col("before") + F.col("low")).alias("first"), F.sum("n").alias("size"))
    numbered = ordered(starts, ["first"])
    counts = numbered.groupBy(part().alias("p")).agg(F.count("*").alias("n"))
    return numbered.withColumn("p", part()).join(offsets(counts), "p").select("source", place().alias("tree"), "first", "size")


def parents(nodes: DataFrame) -> DataFrame:
    """One level up from ``tree, node, hash, n`` (n nodes of the tree at this level); trees of one node are finished."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    grouped = nodes.where("n > 1").groupBy("tree", F.shiftright("node", 4).alias("parent")).agg(children.alias("children"), F.max("n").alias("n"))
    pre = F.array_join(F.col("children.hash"), "")
    return grouped.select("tree", F.col("parent").alias("node"), pre.alias("pre"), h(pre).alias("hash"), F.floor((F.col("n") + FAN - 1) / FAN).alias("n"))


def levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All levels above ``nodes``, the lowest first, of trees with ``most`` nodes at most."""
    out = []
    while most > 1:
        nodes = staged(parents(nodes))
        out.append(nodes)
        most = -(-most // FAN)
    return out


def tops(nodes: DataFrame, up: list[DataFrame]) -> DataFrame:
    """``tree, hash`` of each tree's last node."""
    found = nodes.where("n = 1").select("tree", "hash")
    for level in up:
        found = found.union(level.where("n = 1").select("tree", "hash"))
    return found


def step(pre: str, node: str) -> Column:
    """An ancestor's preimage, and the place of the child's digest in it."""
    return F.array(F.struct(F.col(pre).alias("pre"), (F.col(node) % FAN).cast("int").alias("slot")))


def none() -> Column:
    return F.array().cast("array<struct<pre: string, slot: int>>")


def beyond(up: list[DataFrame], roots: DataFrame) -> DataFrame:
    """For each parent of the lowest level ``tree, node, pre, above, subroot``: the steps from it to the last root.

    ``roots`` are each tree's ``subroot``, its leaves' count ``size`` and the ``steps`` from there. Trees of a single
    leaf have a row without a preimage. Each join is of a level with the next, a sixteenth of its size.
    """
    above = None
    for level in reversed(up):
        top = level.where("n = 1").join(roots.withColumnRenamed("steps", "above"), "tree").select("tree", "node", "pre", "above", "subroot")
        if above is None:
            above = top
            continue
        own = level.where("n > 1").withColumn("parent", F.shiftright("node", 4))
        over = above.select("tree", F.col("node").alias("parent"), F.col("pre").alias("over"), F.col("above").alias("rest"), "subroot")
        above = own.join(over, ["tree", "parent"]).select("tree", "node", "pre", F.concat(step("over", "node"), "rest").alias("above"), "subroot").union(top)
    lone = roots.where("size = 1").select("tree", F.lit(0).cast("long").alias("node"), F.lit(None).cast("string").alias("pre"), F.col("steps").alias("above"), "subroot")
    return lone if above is None else above.union(lone)


def steps_from(nodes: DataFrame, up: list[DataFrame], roots: DataFrame) -> DataFrame:
    """``nodes`` with ``steps``, from each to the last root, and the tree's ``subroot``."""
    lowest = beyond(up, roots).withColumnRenamed("node", "parent")
    joined = nodes.withColumn("parent", F.shiftright("node", 4)).join(lowest, ["tree", "parent"])
    own = F.when(F.col("pre").isNull(), none()).otherwise(step("pre", "node"))
    return joined.withColumn("steps", F.concat(own, "above")).drop("parent", "pre", "above")


def left(s: Column) -> Column:
    return F.substring(s["pre"], F.lit(1), s["slot"] * DIGEST)


def right(s: Column) -> Column:
    return F.substring(s["pre"], (s["slot"] + 1) * DIGEST + 1, F.lit(FAN * DIGEST))


def siblings(steps: str) -> Column:
    """The digests of all siblings on the way to the root, from left to right, level by level."""
    return F.array_join(F.transform(steps, lambda s: F.concat(left(s), right(s))), "")


def folded(digest: Column, steps: str) -> Column:
    """The root that a leaf's digest gives, its own taking its place in every ancestor's preimage."""
    return F.aggregate(steps, digest, lambda now, s: h(left(s), now, right(s)))


def crc_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def lowered(text: str = "text") -> Column:
    """The text with A-Z in lower case; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Manifest:
    """The trees of a dataset: ``leaves`` (with their place), ``sources``, ``inner`` and ``outer`` levels, and the ``root``."""

    def __init__(self, docs: DataFrame) -> None:
        rows = docs.select(*FIELDS)
        tampered = F.when(crc_of_id() % 5 == 0, leaf(lowered()))
        leaves = ordered(rows.select("source", "doc_id", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered")), ["source", "doc_id", "leaf"])
        runs = staged(leaves.groupBy(part().alias("p"), "source").agg(F.min(F.col("at").bitwiseAND((1 << 33) - 1)).alias("low"), F.count("*").alias("n")))
        self.sources = staged(placed_sources(runs))
        # Leaves meet their source by their partition too: a source of many leaves has many such rows.
        same = F.col("source").eqNullSafe(F.col("of"))
        starts = runs.join(self.sources.withColumnRenamed("source", "of"), same).select("p", "of", "tree", "first", "size").join(offsets(runs), "p")
        joined = leaves.join(starts, (part() == F.col("p")) & same)
        self.leaves = joined.select("tree", (place() - F.col("first")).alias("node"), F.col("size").alias("n"), "doc_id", "leaf", "tampered")
        self.most, self.trees = self.sources.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
        nodes = self.leaves.select("tree", "node", F.col("leaf").alias("hash"), "n")
        self.inner = levels(nodes, self.most)
        self.subroots = staged(tops(nodes, self.inner))
        top = self.subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("node"), "hash", F.lit(self.trees).alias("n"))
        self.outer = levels(top, self.trees)
        last = tops(top, self.outer).first()
        self.root = last["hash"] if last else None
        beginning = self.subroots.sparkSession.range(1).select(F.col("id").alias("tree"), none().alias("steps"), F.lit(self.root).alias("subroot"), F.lit(self.trees).alias("size"))
        found = steps_from(top, self.outer, beginning).select(F.col("node").alias("tree"), "steps", F.col("hash").alias("subroot"))
        self.roots = staged(found.join(self.sources.select("tree", "size"), "tree"))

    def table(self) -> DataFrame:
        """The manifest itself: ``source`` (null in the tree over all sources), ``over_sources``, ``level``, ``node``, ``digest``, ``preimage``."""
        kept = lambda level, k: level.select("tree", F.lit(k).alias("level"), "node", F.col("hash").alias("digest"), F.col("pre").alias("preimage"))
        inner = [kept(level, k + 1).join(self.sources.select("tree", "source"), "tree").withColumn("over_sources", F.lit(False)) for k, level in enumerate(self.inner)]
        outer = [kept(level, k + 1).select("*", F.lit(None).cast("string").alias("source"), F.lit(True).alias("over_sources")) for k, level in enumerate(self.outer)]
        columns = ["source", "over_sources", "level", "node", "digest", "preimage"]
        out = self.leaves.sparkSession.createDataFrame([], StructType.fromDDL("source string, over_sources boolean, level int, node long, digest string, preimage string"))
        for level in inner + outer:
            out = out.union(level.select(*columns))
        return out

    def proofs(self) -> DataFrame:
        """Each leaf with the ``steps`` to the root, and its source's ``subroot``."""
        return steps_from(self.leaves, self.inner, self.roots)


def manifest(docs: DataFrame) -> DataFrame:
    """The preimages of all parents: ``source, over_sources, level, node, digest, preimage``; empty for an empty table.

    A source of a single row has no parent of its own; a single source has none over the sources.
    """
    return Manifest(docs).table()


def verify(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row.

    Rows in which 5 divides the crc32 of the id are folded as if A-Z of the text had been lower-cased. Null ids come
    first in their source and aren't changed; rows of one id are ordered by digest, and repeated rows are leaves as
    often as they are there. A null source is a source of its own. An empty table gives no rows; other columns
    are left out.
    """
    m = Manifest(docs)
    now = folded(F.coalesce("tampered", "leaf"), "steps")
    return m.proofs().select("doc_id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), F.sha2(siblings("steps"), 256).alias("proof_sha256"), now.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
