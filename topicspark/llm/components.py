"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.llm.common import write_table


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): root is the smallest node of its component.

    Each round is written to the shared folder; rounds end when the edges no longer change, after a number of rounds
    that grows with the logarithm of the components' diameter. Without edges there are no rows.
    """
    now = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least(F.min("b").over(W.partitionBy("a")), F.col("a"))
        large = both.withColumn("m", low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # of each node, the smaller neighbours: all edges point down already
        least = F.min("b").over(W.partitionBy("a"))
        small = large.where("a <> b").distinct().withColumn("m", least)
        down = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        now = write_table(down.select("e.a", "e.b").where("a <> b").distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def link_classes(members: DataFrame, pairs: DataFrame, sizes: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``id, class_id, n_links`` of every row of ``members`` (``id, node``: the id that stands for it) by links between
    nodes (``pairs``: ``a, b``, each once): the smallest node that links connect with its own, and how many other ids
    have its node or one linked to it. No pair of ids is formed. ``sizes``: ``node, m``, the rows of each node, if it is
    there already. ``counted``: ``node, near, low`` of links that aren't in ``pairs``: how many rows they lead to, and a
    smaller or the same node that they connect it with; a node may have several such rows."""
    if sizes is None:
        sizes = write_table(members.groupBy("node").agg(F.count("*").alias("m")), "sizes")
    both = pairs.select(F.col("a").alias("to"), F.col("b").alias("node")).unionByName(pairs.select(F.col("b").alias("to"), F.col("a").alias("node")))
    near = both.join(sizes, "node").select(F.col("to").alias("node"), F.col("m").alias("near"))
    edges = pairs.select("a", "b")
    if counted is not None:
        near = near.unionByName(counted.select("node", "near"))
        edges = edges.unionByName(counted.select(F.col("node").alias("a"), F.col("low").alias("b")))
    near = near.groupBy("node").agg(F.sum("near").alias("near"))
    found = sizes.where("m > 1").join(near, "node", "full").join(components(edges).withColumnRenamed("root", "class_id"), "node", "left")
    found = write_table(found.select("node", "class_id", (F.coalesce("m", F.lit(1)) - 1 + F.coalesce("near", F.lit(0))).alias("n_links")), "linked")
    all_of = members.join(found, "node", "left")
    return all_of.select("id", F.coalesce("class_id", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def all_pairs(pairs: DataFrame, same: Column) -> DataFrame:
    """The pairs of all rows from ``pairs`` (``left_id, right_id``, ...) in which the smallest id of a group of identical
    rows stands for the group: ``same`` is true where a row is tied to it. Other columns are those of the pair it comes
    from. A group of n gives n (n - 1) / 2 pairs."""
    others = [F.col(f"`{c}`") for c in pairs.columns if c not in ("left_id", "right_id")]
    tied, near = pairs.where(same), pairs.where(~same)
    groups = tied.select(F.col("left_id").alias("_node"), F.col("right_id").alias("_id")).union(tied.select("left_id", "left_id").distinct())
    within = tied.join(groups, (F.col("left_id") == F.col("_node")) & (F.col("_id") < F.col("right_id"))).select(F.col("_id").alias("left_id"), "right_id", *others)
    for side in ("left_id", "right_id"):
        near = near.join(groups, F.col(side) == F.col("_node"), "left").withColumn(side, F.coalesce("_id", side)).drop("_node", "_id")
    ordered = near.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), *others)
    return ordered.unionByName(within)
