"""What the operators of this subpackage share: scratch tables, gapless numbering and connected components."""

import contextlib
import functools
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import shared_folder

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession, rows: int = 2_000, size: int = 8 << 20) -> None:
    """Let at most ``rows`` rows and about ``size`` bytes go to a Python worker at once, where the session has Spark's defaults."""
    for key, default, value in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "67108864b", size)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, str(value))


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage: after the loss of an executor only the current step is
    computed again. The shuffle files of a step are freed once its table stands.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark)}/tidelake-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.saved = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.saved += 1
        path = f"{self.root}/{name}-{self.saved}"
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        with contextlib.suppress(Exception):
            self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(FREE_SHUFFLES)
            else:
                self.spark.conf.set(FREE_SHUFFLES, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))


#: Odd multipliers for hashing.
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit integers, each bit of which depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(32))) * ODD[4]
    x = (x ^ (x >> np.uint64(29))) * ODD[5]
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """The 64-bit hashes of words, as signed integers; up to ``keep`` are remembered."""

    def __init__(self, keep: int = 300_000):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of so many equal ranges of hash values each lies in."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def dealt(by: str, key: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row a value of ``key``, with the values of each column as bytes, in the order given: far fewer rows to shuffle."""
    order = np.argsort(key, kind="stable")
    there, first = np.unique(key[order], return_index=True)
    cuts = [*first.tolist(), len(key)]
    return pd.DataFrame({by: there, **{name: [v[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for name, v in ((n, c[order]) for n, c in columns.items())}})


def cell_of(row: str, bits: int) -> Column:
    """The cell of a row number: 2 ** bits rows that were read together."""
    return F.shiftright(row, bits).alias("cell")


def row_number(size: Column, bits: int, long: int) -> Column:
    """A number for each row; one whose ``size`` is over ``long`` gets a cell that no other row has."""
    number = F.monotonically_increasing_id()
    return F.when(size > long, F.lit(-1) - F.shiftleft(number, bits)).otherwise(number).alias("row")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_cell: int = 100_000) -> DataFrame:
    """Add ``out``: gapless numbers from 0 within each combination of ``keys``.

    A key may hold any share of the rows, so no task gets a whole key: the rows of a key are dealt
    to cells by a hash of ``order``, each cell is numbered by itself, and a cell's numbers start
    after those of the cells before it. Rows that are equal in ``order`` share a cell, so that a column that tells rows apart
    should end it. ``df`` is read twice and should be a written table.
    """
    cells = max(64, -(-df.count() // rows_per_cell))
    cell, rank, start, n = (fresh(name, [*df.columns, out]) for name in ("cell", "rank", "start", "n"))
    dealt_rows = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(cells)))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt_rows.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias(n)).withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0)))
    there = sizes.select(*[F.col(c).alias(f"{c}{k}") for k, c in enumerate([start, *keys, cell])])
    ranked = dealt_rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order)) - 1)
    same = functools.reduce(Column.__and__, [ranked[c].eqNullSafe(there[f"{c}{k}"]) for k, c in enumerate([*keys, cell], 1)])
    return ranked.join(there, same).select(*[ranked[c] for c in df.columns], (there[f"{start}0"] + ranked[rank]).alias(out))


def crowd_join(rows: DataFrame, facts: DataFrame, key: str, copies: str, total: int, crowds: int = 2_000) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one row a key; ``copies``: how many rows have it), no task with a crowd's rows.

    At most ``crowds`` keys have a ``crowds``-th of the ``total`` rows or more each: their facts are broadcast,
    and their rows stay where they are. All others are joined by a shuffle.
    """
    crowd = F.col(copies) >= max(2, -(-total // crowds))
    hot = F.broadcast(facts.where(crowd))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(~crowd), key, "left")
    return rows.join(hot, key).unionByName(rest)


def salted_join(
    rows: DataFrame, facts: DataFrame, key: str, copies: str, total: int, by: list[str], cells: int = 2_000, least: int = 1_000
) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one row a key, of any size; ``copies``: how many rows have it), no task with a crowd's rows.

    The rows of a key that has more than a ``cells``-th of the ``total``, and more than ``least``, are dealt to cells by a hash of
    ``by``, and each cell gets its own copy of the fact: at most ``cells`` copies besides one a key. Fewer than ``cells`` keys and
    numbers are broadcast. ``facts`` is read twice.
    """
    many, cell = fresh("many", [*rows.columns, *facts.columns]), fresh("cell", [*rows.columns, *facts.columns])
    dealt_facts = facts.withColumn(many, F.ceil(F.col(copies) / max(least, -(-total // cells)))).drop(copies)
    hot = F.broadcast(dealt_facts.where(F.col(many) > 1).select(key, many))
    deal = F.coalesce(F.pmod(F.xxhash64(*by), F.col(many)), F.lit(0).cast("long"))
    spread = dealt_facts.withColumn(cell, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(many), F.lit(1)) - 1))).drop(many)
    return rows.join(hot, key, "left").withColumn(cell, deal).drop(many).join(spread, [key, cell], "left").drop(cell)


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for the nodes of the long pairs (a, b): root is the component's least node.

    Each round hooks every node, and its present root, to the least root among its neighbours, then
    halves the paths; all of it is joins and minima, so that a component of any size is spread over
    tasks. Rounds grow with the logarithm of the longest path. Each round's table is written.
    """
    both = scratch.save(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges"
    )
    roots = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), f"{name}-roots")
    step = 0
    while True:
        step += 1
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        seen = both.join(a, "a").join(b, "b").where("ra <> rb")
        offers = seen.select(F.explode(F.array("a", "ra")).alias("node"), F.least("ra", "rb").alias("offer"))
        best = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = roots.join(best, "node", "left").select("node", F.least("root", F.coalesce("offer", "root")).alias("root"))
        hooked = scratch.save(hooked, f"{name}-hooked-{step}")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = scratch.save(hooked.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), f"{name}-roots-{step}")
        changed = new.join(roots.withColumnRenamed("root", "old"), "node").where("moved or root <> old").limit(1).count()
        scratch.drop(f"{name}-hooked-{step}", f"{name}-roots" if step == 1 else f"{name}-roots-{step - 1}")
        roots = new.select("node", "root")
        if not changed:
            scratch.drop(f"{name}-edges")
            return roots
