"""Layered datasets: where they lie, how they are written, and what was written."""

import math
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..scratch import file_system
from ..scratch import written as written_table
from ..sources.dated import days_between, scan, scan_range
from ..sources.discovery import inventory

#: The folder of each layer, and the sizes that files should have.
LAYERS = {"L1": "l1", "L2": "features", "L3": "signals"}
MIB = 1024**2
LEAST_BYTES, GOAL_BYTES, MOST_BYTES, GROUP_ROWS = 200 * MIB, 300 * MIB, 500 * MIB, 122_880

#: Bytes of the sources that a task is given to sort, where folders are small: sorted rows take many times as much memory. And as many
#: tasks at most, unless there are more files.
TASK_BYTES, TASKS = 4 * MIB, 4096

#: Spark's estimate for a source that tells none is the greatest long.
UNKNOWN = 1 << 62

#: What each field may hold, and the fields that each kind of source needs.
ALLOWED = {
    "mode": {"in_place", "batch", "poll"},
    "shape": {"tabular", "text", "binary"},
    "layer": set(LAYERS),
    "strategy": {None, "pump", "watch"},
}
NEEDS = {
    "in_place": ("locator",),
    "batch": ("partition_keys",),
    "poll": ("partition_keys", "strategy"),
}


@dataclass(frozen=True)
class Source:
    """What a source promises; checked before anything of it is written."""

    name: str
    mode: str = "batch"
    shape: str = "tabular"
    layer: str = "L1"
    partition_keys: tuple[str, ...] = ()
    time_column: str | None = None
    locator: str | None = None
    strategy: str | None = None
    freshness_days: int = 2
    tags: dict = field(default_factory=dict)

    def faults(self) -> list[str]:
        """Everything that is wrong with the declaration; none if it may be used."""
        odd = [f"{f} cannot be {getattr(self, f)!r}" for f, values in ALLOWED.items() if getattr(self, f) not in values]
        needed = list(NEEDS.get(self.mode, ()))
        if self.mode != "in_place" and self.shape != "binary":
            needed.append("time_column")  # rows are sorted by it within a file
        odd += [f"{f} is needed" for f in needed if not getattr(self, f)]
        if self.strategy and self.mode != "poll":
            odd.append("only a polled source has a strategy")
        return odd

    def __post_init__(self):
        if odd := self.faults():
            raise ValueError(f"{self.name}: {'; '.join(odd)}")


def _plain(part: str, also: str) -> bool:
    return part.isascii() and part[:1].isalnum() and part.translate({ord(c): None for c in also}).isalnum()


def dataset_path(root: str, layer: str, **keys: str) -> str:
    """<root>/<layer>/k=v/... in the caller's order.

    A key is lower-case letters, digits and underscores after a letter; a value is letters, digits, dots, dashes
    and underscores after a letter or digit.
    """
    for k, v in keys.items():
        if not (_plain(k, "_") and k == k.lower() and k[0].isalpha() and _plain(str(v), "._-")):
            raise ValueError(f"not a partition: {k}={v}")
    return "/".join([root.rstrip("/"), LAYERS[layer], *(f"{k}={v}" for k, v in keys.items())])


def plan_files(size: int) -> tuple[int, str | None]:
    """How many files ``size`` bytes make, near the goal and none over the most; a warning where one file is too small."""
    if size <= 0:
        raise ValueError("nothing to write")
    if size < LEAST_BYTES:
        return 1, f"{size} bytes make a file under {LEAST_BYTES}"
    return max(round(size / GOAL_BYTES), math.ceil(size / MOST_BYTES)), None


def files_of(size: Column) -> Column:
    """plan_files over a column of sizes, for datasets that are planned at once; null where there is nothing to write."""
    whole = F.greatest(F.bround(size / GOAL_BYTES), F.ceil(size / MOST_BYTES))
    return F.when(size > 0, F.when(size < LEAST_BYTES, 1).otherwise(whole)).cast("long")


def source_bytes(df: DataFrame) -> int:
    """What the files that ``df`` is made from hold, as far as its columns are read: the sum over the plan's sources.

    The plan's own estimate would multiply both sides of a join. A source of which Spark does not know the size counts as empty; give
    the size where that is the larger part.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < UNKNOWN)


def planned(df: DataFrame, size: int | None = None) -> int:
    """Files for ``size`` bytes, or for as many as ``df``'s sources hold."""
    return plan_files(max(1, source_bytes(df) if size is None else size))[0]


def _cut(df: DataFrame, keys: list[str], size: int, files: int | None) -> tuple[DataFrame | None, int]:
    """The combinations of ``keys`` with more rows than make one file (one row each), and the files of all these; None if there are none.

    At most as many as there are files, and found by one pass that reads the keys only.
    """
    n = written_table(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "folders")
    share = F.col("_n") / (n.agg(F.sum("_n")).first()[0] or 1)
    of_key = F.round(share * files) if files else files_of(F.ceil(share * size))
    large = written_table(n.withColumn("_files", of_key.cast("long")).where("_files > 1"), "large")
    most = large.agg(F.sum("_files")).first()[0]
    return (large.select(*keys), most) if most else (None, 0)


def write(
    df: DataFrame, path: str, keys: list[str], time: str, mode: str = "overwrite", files: int | None = None, size: int | None = None,
    seen: Observation | None = None,
) -> None:
    """zstd files, sorted by keys and time, under one folder for each combination of ``keys``.

    A combination is one file in a task of few others, about TASK_BYTES of the sources together. Only one with more than a file's rows
    is dealt to ranges of time, each a file, so that a day with a third of all rows is spread over tasks like any other. Without keys all
    rows are dealt to ranges. ``seen`` gets the rows that were written.
    """
    size = source_bytes(df) if size is None else size
    ranges = files or planned(df, size)
    large, cuts = _cut(df, keys, size, files) if keys and ranges > 1 else (None, 0)
    if not keys:
        dealt = df.repartitionByRange(ranges, time)
    else:
        tasks = max(ranges, min(TASKS, -(-size // TASK_BYTES)))
        same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"large.{k}")) for k in keys]
        one = df if large is None else df.alias("rows").join(F.broadcast(large.alias("large")), same, "left_anti")
        dealt = one.repartition(tasks, *keys)
        if large is not None:
            many = df.alias("rows").join(F.broadcast(large.alias("large")), same, "left_semi")
            dealt = dealt.unionByName(many.repartitionByRange(cuts, *keys, time))
    if seen is not None:  # behind the exchange, which may read its input once more to find ranges
        dealt = dealt.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = dealt.sortWithinPartitions(*keys, time).write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    writer = writer.option("parquet.block.row.count.limit", str(GROUP_ROWS))
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def publish(df: DataFrame, path: str, least_rows: int = 1) -> int:
    """Write aside, count, and only then put into place; an empty result is refused. Returns the rows.

    What was there is moved aside before the new folder is moved in and deleted after, so that at every moment
    one of them stands under ``path`` or beside it: a call that finds only the moved one puts it back first.
    """
    spark = df.sparkSession
    parent, name = path.rstrip("/").rsplit("/", 1)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs, target = file_system(spark, path)
    old, new = hadoop(f"{parent}/_previous-{name}"), hadoop(f"{parent}/_staging-{name}-{uuid.uuid4().hex}")
    if fs.exists(old):
        if fs.exists(target):  # an earlier call ended before it could delete the old one
            fs.delete(old, True)
        else:
            fs.rename(old, target)
    df.write.option("compression", "zstd").parquet(str(new.toString()))
    rows = spark.read.schema(df.schema).parquet(str(new.toString())).count()
    if rows < least_rows:
        fs.delete(new, True)
        raise ValueError(f"{rows} rows for {path}; not published")
    fs.mkdirs(target.getParent())
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"could not move what is at {path} aside")
    if not fs.rename(new, target):
        if fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"could not publish {path}")
    fs.delete(old, True)
    return rows


def present(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The values of ``key`` among the k=v folders right under ``path``: one listing, no file is read."""
    fs, p = file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    values = [(n.split("=", 1)[1],) for n in names if n.startswith(f"{key}=")]
    return spark.createDataFrame(values, f"{key} string")


def _observed(seen: Observation) -> int:
    """The rows that a write has observed; where Spark saw beforehand that there are none, it has observed nothing."""
    try:
        return seen.get["rows"]
    except Py4JJavaError:
        return 0


def load_missing(wanted: DataFrame, rows: DataFrame, path: str, key: str, time: str) -> DataFrame:
    """Write the rows of wanted periods (column ``key``) that ``path`` lacks; period, rows and status of each wanted one.

    ``rows`` is read once, beside what ``write`` needs where they make more than a file: what was written is counted from the new folders' footers, and must be as many rows as the write has
    observed.
    """
    spark = rows.sparkSession
    there = present(spark, path, key)
    todo = wanted.join(there, key, "left_anti")
    seen = Observation()
    write(rows.join(todo, key, "left_semi"), path, [key], time, seen=seen)
    after = present(spark, path, key).join(there, key, "left_anti")
    folders = [f"{path}/{key}={r[0]}" for r in after.toLocalIterator()]  # a folder a period
    schema = f"{key} string, written long"
    if folders:
        files = spark.read.option("basePath", path).schema(rows.schema).parquet(*folders)
        counts = files.groupBy(F.col(key).cast("string").alias(key)).agg(F.count(F.lit(1)).alias("written"))
    else:
        counts = spark.createDataFrame([], schema)
    counts = written_table(counts, "counts")
    total, made = counts.agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0], _observed(seen)
    if total != made:
        raise RuntimeError(f"{made} rows were written to {path}, {total} are there")
    status = F.when(F.col("_there"), "skipped").when(F.col("written") > 0, "written").otherwise("missing")
    marked = wanted.join(there.withColumn("_there", F.lit(True)), key, "left").join(counts, key, "left")
    return marked.select(key, F.coalesce("written", F.lit(0)).alias("written"), status.alias("status"))


def copy_days(spark: SparkSession, table_root: str, out: str, first: str, last: str, time: str) -> DataFrame:
    """Copy the days of a date= tree that ``out`` lacks, each sorted by time; day, rows and status of every day of the range.

    Files are read and written anew, all days in one job; only folders of the range are listed. A day without a partition is reported as missing.
    """
    days = days_between(spark, first, last).select(F.date_format("day", "yyyy-MM-dd").alias("date"))
    rows = scan_range(spark, table_root, first, last)
    return load_missing(days, rows.withColumn("date", F.date_format("date", "yyyy-MM-dd")), out, "date", time)


def archive_day(spark: SparkSession, table_root: str, out: str, day: str, time: str) -> dict:
    """One day of a date= tree: sorted, counted, refused when empty, published; the catalog row of the write."""
    df = scan(spark, table_root, day).drop("date")
    path = f"{out.rstrip('/')}/date={day}"
    rows = publish(df.repartitionByRange(planned(df), time).sortWithinPartitions(time), path)
    fs, p = file_system(spark, path)
    held = fs.getContentSummary(p)
    name = out.rstrip("/").rsplit("/", 1)[-1]
    files = sum(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(p))
    return {"dataset": name, "path": out, "rows": rows, "bytes": held.getLength(), "files": files, "time_min": day, "time_max": day}


def dataset_stats(spark: SparkSession, root: str) -> DataFrame:
    """files, bytes and undersized files of a tree, and its rows."""
    names = ("files", "bytes", "undersized", "rows")
    zero = F.lit(0).cast("long")
    size = F.col("length")
    of_files = inventory(spark, root).select(F.lit(1), size, (size < LEAST_BYTES).cast("long"), zero)
    of_rows = spark.read.parquet(root).agg(F.lit(0), zero, zero, F.count(F.lit(1)))
    return of_files.toDF(*names).union(of_rows.toDF(*names)).agg(*[F.sum(c).alias(c) for c in names])


def written_stats(spark: SparkSession, path: str, day: str, entity: str) -> DataFrame:
    """rows, first and last day, and distinct entities of what lies at ``path``."""
    span = F.min(day).alias("first_day"), F.max(day).alias("last_day")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), *span, F.count_distinct(entity).alias("entities"))


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines, only ever appended."""
    df.write.mode("append").json(path)
