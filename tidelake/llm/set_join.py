"""Links between sets that are alike: a prefix-filtered join of sets of 64-bit signatures, sizes first.

Sizes are cut into partitions that grow by 1 / ``least``, so that two sets so alike lie in one partition or in
neighbours. Within a partition, sets are candidates if they share one of the rarest signatures that a pair so
alike must share; the bound on sizes and the exact Jaccard likeness follow.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, components


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness, 1 of two empty sets; 0 where the sizes alone keep it under ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(1.0))
    return F.when(small < least * large, F.lit(0.0)).otherwise(exact) if least > 0 else exact


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose sets (node, signs) have the likeness ``least``."""
    # sets are large rows: sorted and merged at every size, so that no size has a plan of its own
    a, b = (sets.select("node", "signs").toDF(x, f"signs_{x}").hint("merge") for x in "ab")
    return pairs.distinct().join(a, "a").join(b, "b").where(likeness(F.col("signs_a"), F.col("signs_b"), least) >= least).select("a", "b")


def links(sets: DataFrame, least: float, scratch: Scratch, few: int = 64) -> DataFrame:
    """Pairs (a, b) of nodes, of likeness ``least`` or more, that connect all pairs so alike. sets: node, signs
    (distinct and not empty; no two sets equal).

    A crowd of like sets first meets its cell's least one, so that it becomes one component by as many
    pairs as it has sets; then the sets of different components that share a cell meet. Cells of more than ``few`` sets are
    split by a second signature: two sets so alike share two signatures of the prefixes that are one longer (or have one only
    and are equal), and the rarest that they share is in both shorter ones. Nothing is cut.
    """
    sized = sets.select("node", "signs", F.size("signs").alias("size"))
    counts = sized.select(F.explode("signs").alias("sign")).groupBy("sign").agg(F.count(F.lit(1)).alias("n"))
    ranked = sized.select("node", "size", F.explode("signs").alias("sign")).join(counts, "sign")
    ordered = ranked.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "sign"))).alias("order"))  # one set
    first = F.size("order") - F.ceil(F.lit(least) * F.size("order")).cast("int") + 1
    part = F.floor(F.log(F.col("size").cast("double")) / -math.log(least)).cast("int")

    def prefix(length: Column) -> Column:
        """Signatures that no other set has are left out."""
        return F.transform(F.filter(F.slice("order", F.lit(1), length), lambda o: o["n"] > 1), lambda o: o["sign"])

    prefixes = scratch.save(ordered.select("node", "size", part.alias("part"), prefix(first).alias("short"), prefix(first + 1).alias("longer")), "prefixes")
    # a cell has the sets of two neighbouring partitions that share a prefix signature
    tokens = prefixes.select("node", "size", "part", F.explode("short").alias("sign"))
    cells = scratch.save(tokens.select("node", "size", "sign", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part")), "cells")
    pivots = cells.groupBy("part", "sign").agg(F.min("node").alias("a"))
    to_pivot = scratch.save(alike(cells.join(pivots, ["part", "sign"]).where("node <> a").select("a", F.col("node").alias("b")), sets, least), "to-pivot")
    roots = scratch.save(components(to_pivot, scratch, "first"), "first-roots")
    placed = scratch.save(cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    mixed = placed.groupBy("part", "sign").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    left = scratch.save(placed.join(mixed.select("part", "sign", "n"), ["part", "sign"]), "left")

    def pairs(members: DataFrame, keys: list[str]) -> DataFrame:
        a, b = (members.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "root")]) for x in "ab")
        near = (F.col("root_a") < F.col("root_b")) & (F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b"))
        return a.join(b, keys).where(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    crowd = left.where(F.col("n") > few).join(prefixes.select("node", F.explode("longer").alias("second")), "node").where("second <> sign")
    met = pairs(left.where(F.col("n") <= few), ["part", "sign"]).unionByName(pairs(crowd, ["part", "sign", "second"]))
    return to_pivot.unionByName(alike(met, sets, least))
