"""Sharding: best-fit-decreasing bin packing of indivisible groups.

A group is all documents with one text; it is never divided. Groups are sorted by size and each
enters the bin with the least remaining capacity that still holds it, found in a balanced tree.

Groups of one size are interchangeable: they enter bins one after another until the tightest one is full for their size. So
what the driver packs is how many groups there are of each size, and the plan says which bin the first, second and so on of
a size enter; the groups are numbered within their size and find their bins in tasks. For the plan, sizes over 65,536
are rounded up to 16 significant bits, at every number of documents: that bounds the sizes by 1.6 million.
"""

import bisect
import math
import random
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import Scratch, crowd_join, numbered, text_of

Run = tuple[int, int, int, int]  # size, number of the first group of that size, how many, bin


class CapacityTree:
    """A treap over (remaining capacity, bin): balanced by random priorities of a fixed seed."""

    def __init__(self):
        self.root, self.random = None, random.Random(17)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            return [node[0], node[1], node[2], left], right
        left, right = self._split(node[2], key)
        return left, [node[0], node[1], right, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]

    def add(self, key):
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.random.random(), None, None]), right)

    def remove(self, key):
        left, right = self._split(self.root, key)
        _, right = self._split(right, (key[0], key[1] + 1))
        self.root = self._merge(left, right)

    def tightest(self, size):
        """The least (remaining, bin) with remaining >= size, or None."""
        node, found = self.root, None
        while node is not None:
            if node[0] >= (size, -1):
                found, node = node[0], node[2]
            else:
                node = node[3]
        return found


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Run]:
    """Where the groups of each size go. Groups over the capacity get a bin of their own."""
    tree, bins, runs = CapacityTree(), 0, []
    for size in sorted(counts, reverse=True):
        done, total = 0, counts[size]
        while done < total:
            found = tree.tightest(size)
            if found is None:
                found = (max(capacity, size), bins)
                bins += 1
            else:
                tree.remove(found)
            # the bin that has just taken one stays the tightest as long as another fits
            n = min(total - done, found[0] // size)
            runs.append((size, done, n, found[1]))
            tree.add((found[0] - n * size, found[1]))
            done += n
    return runs


def bins_of(runs: Iterable[Run]) -> int:
    return max((r[3] for r in runs), default=-1) + 1


def least_capacity(counts: dict[int, int], bins: int, steps: int = 10_000) -> list[Run]:
    """Best-fit-decreasing with the least capacity, to one part in ``steps``, that needs at most ``bins`` bins."""
    total, largest = sum(k * n for k, n in counts.items()), max(counts, default=1)
    low = max(-(-total // bins), largest)

    def capacity(k: int) -> int:
        return low + math.ceil(low * k / steps)

    def fits(k: int) -> bool:
        return bins_of(best_fit_decreasing(counts, capacity(k))) <= bins

    high = 1
    while high < steps and not fits(high - 1):  # mostly the least capacity does, or nearly
        high *= 2
    k = bisect.bisect_left(range(min(high, steps)), True, lo=high // 2, key=fits)
    return best_fit_decreasing(counts, capacity(k))


def planned_size(size: Column) -> Column:
    """The size that counts for the plan: rounded up to 16 significant bits."""
    extra = F.greatest(F.length(F.bin(size)) - 16, F.lit(0))
    unit = F.pow(F.lit(2.0), extra).cast("long")
    return (F.ceil(size / unit) * unit).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size in bytes plus 1, checksum, and the digest that names its group."""
    text = text_of()
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("copies"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """copies, how many rows have that text, and the size for the plan."""
    return rows.groupBy("copies").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("members")).withColumn("bytes", planned_size(F.col("bytes")))


def into_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All documents in ``shards`` shards of nearly equal bytes; copies of one text stay together.

    Returns doc_id, size, text_crc32, shard, slot. Null texts count as empty (size 1); repeated rows
    are documents of their own; null ids are kept; no rows give no rows; other columns are not looked at, whatever their
    names. Where one group is larger than a shard's share, that share cannot be equal: the group fills a shard alone.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(sized(docs), "sized")
    groups = scratch.save(_groups(rows), "groups")
    counts = {r["bytes"]: r["count"] for r in groups.groupBy("bytes").count().collect()}  # at most 1.6 million sizes
    runs = sorted(least_capacity(counts, shards))
    table = spark.sparkContext.broadcast(np.array(runs or [(0, 0, 0, 0)], np.int64))  # as many, and ``shards`` more for each size that changes bins

    @pandas_udf("int")
    def shard_of(size: pd.Series, number: pd.Series) -> pd.Series:
        t = table.value
        sizes, first = np.unique(t[:, 0], return_index=True)
        key = (np.searchsorted(sizes, size.to_numpy(np.int64)) << 40) + number.to_numpy(np.int64)
        keys = (np.repeat(np.arange(len(sizes)), np.diff(np.append(first, len(t)))) << 40) + t[:, 1]
        return pd.Series(t[np.searchsorted(keys, key, side="right") - 1, 3].astype(np.int32))

    ranked = numbered(groups, ["bytes"], ["copies"], "number")
    homes = scratch.save(ranked.select("copies", "members", shard_of("bytes", "number").alias("shard")), "homes")
    placed = crowd_join(rows, homes, "copies", "members", rows.count()).select("doc_id", "size", "text_crc32", "shard")
    placed = scratch.save(placed.withColumn("row", F.monotonically_increasing_id()), "placed")
    scratch.drop("sized", "groups", "homes")
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size", "row"], "slot").drop("row")


def fixed_capacity(docs: DataFrame, capacity: int, region_bins: int = 1_000) -> DataFrame:
    """As few shards of ``capacity`` bytes as best-fit-decreasing finds: doc_id, size, text_crc32, shard string.

    For any number of shards: the groups are dealt by hash to regions of about ``region_bins`` shards,
    each packed in one task by its histogram of sizes, so that at most one shard a region is filled in part. A group larger
    than the capacity gets a shard of its own.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(sized(docs), "sized")
    groups = rows.groupBy("copies").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("members"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    regions = max(1, round(total / capacity / region_bins))
    groups = groups.withColumn("region", F.pmod(F.xxhash64("copies"), F.lit(regions)))
    ranked = scratch.save(numbered(scratch.save(groups, "groups"), ["region", "bytes"], ["copies"], "number"), "ranked")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        runs = best_fit_decreasing(dict(zip(part["bytes"].tolist(), part["n"].tolist(), strict=True)), capacity)
        frame = pd.DataFrame(runs, columns=["bytes", "first", "n", "bin"])
        return frame.assign(region=part["region"].iloc[0])

    sizes = ranked.groupBy("region", "bytes").agg(F.count(F.lit(1)).alias("n"))
    runs = sizes.groupBy("region").applyInPandas(pack, "bytes long, first long, n long, bin long, region long")
    inside = (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n"))
    name = F.concat_ws("-", "region", "bin").alias("shard")
    homes = scratch.save(ranked.join(runs, ["region", "bytes"]).where(inside).select("copies", "members", name), "homes")
    return crowd_join(rows, homes, "copies", "members", rows.count()).select("doc_id", "size", "text_crc32", "shard")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``bytes``."""
    out = into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
