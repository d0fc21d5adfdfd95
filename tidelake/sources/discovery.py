"""Partition trees: what files there are, views over them, and reading files whose columns differ."""

import functools
import itertools
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import partition_map, view_name
from ..scratch import exists, file_system, new_path, written

WIDENING = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]
#: The first part of the names of views over these folders.
PREFIXES = {"hypersync_output": "chain", "market": "market"}
FOLDER = r"^(.*/)?[^/]*$"


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime, is_synthetic of every Parquet file at any depth; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(root).select("path", "length", "modificationTime", name.startswith("synthetic_").alias("is_synthetic"))


def relative(path: Column, root: str) -> Column:
    """The part of a file's path under ``root``, whatever scheme the listing puts before it."""
    tail = root.rstrip("/").split("://")[-1].lstrip("/")
    return F.substring_index(path, f"{tail}/", -1)


def common_type(types: list[str]) -> str:
    """The type that holds all: numbers widen, anything else that differs becomes a string."""
    kinds = set(types)
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= set(WIDENING) - {"boolean"}:
        return max(kinds, key=WIDENING.index)
    if kinds <= {"date", "timestamp_ntz", "timestamp"}:
        return "timestamp_ntz" if "timestamp" not in kinds else "timestamp"
    return "string"


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames whose columns differ: missing ones are null, types are widened first."""
    kinds: dict[str, list[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, []).append(kind)
    to = {name: common_type(k) for name, k in kinds.items()}
    cast = [f.select(*[F.col(f"`{n}`").cast(to[n]).alias(n) for n in f.columns]) for f in frames]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def strict_concat(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with the same column names; others are refused."""
    for f in frames[1:]:
        if set(f.columns) != set(frames[0].columns):
            raise ValueError(f"columns differ: {sorted(frames[0].columns)} and {sorted(f.columns)}")
    return functools.reduce(DataFrame.unionByName, frames)


FOOTER = "path string, columns string, names string, rows long, fault string"


def _row(path: str, columns: str, names: list[str], rows: int) -> tuple:
    return path, columns, ",".join(sorted(names)), rows, None


def _by_arrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Footers of files that lie in the machines' own file system, read in tasks. Only a file that is no Parquet is told; other errors are raised."""
    import pyarrow.parquet as pq
    from pyarrow import ArrowInvalid, fs

    def footer(path: str) -> tuple:
        store, name = fs.FileSystem.from_uri(path)
        try:
            with store.open_input_file(name) as f:
                file = pq.ParquetFile(f)
                return _row(path, str(file.schema_arrow.remove_metadata()), file.schema_arrow.names, file.metadata.num_rows)
        except ArrowInvalid as e:
            return path, None, None, None, str(e)[:300]

    for batch in batches:
        yield pd.DataFrame([footer(p) for p in batch["path"]], columns=[c.split()[0] for c in FOOTER.split(", ")])


def _by_hadoop(spark: SparkSession, paths: Iterator[str], at_once: int = 32, chunk: int = 10_000) -> Iterator[list[tuple]]:
    """Footers of files in any store that Spark reads, through Hadoop's file system of it; a chunk at a time. Errors as in _by_arrow."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.parquet.hadoop

    def footer(path: str) -> tuple:
        try:
            reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
        except Exception as e:
            if "is not a Parquet file" in str(e):
                return path, None, None, None, str(e).split("\n")[0][:300]
            raise
        try:
            schema = reader.getFileMetaData().getSchema()
            names = [schema.getFieldName(k) for k in range(schema.getFieldCount())]
            return _row(path, schema.toString(), names, reader.getRecordCount())
        finally:
            reader.close()

    with ThreadPoolExecutor(at_once) as pool:
        while part := list(itertools.islice(paths, chunk)):
            yield list(pool.map(footer, part))


def footers(files: DataFrame) -> DataFrame:
    """path, columns, names, rows and fault of Parquet files (column path), from their footers alone; a written table.

    Files of the machines' own file system are read by tasks. Those of other stores are read through Hadoop, as Spark does, by
    threads of the driver, which holds a chunk of them at a time. A file that is no Parquet has a fault; a store that fails is an error.
    """
    spark = files.sparkSession
    own = F.col("path").rlike("^(file:|/)")
    found = written(files.where(own).select("path").mapInPandas(_by_arrow, FOOTER), "footers")
    others = (r["path"] for r in files.where(~own).select("path").toLocalIterator())
    place = new_path(spark, "footers")
    for rows in _by_hadoop(spark, others):
        spark.createDataFrame(rows, FOOTER).write.mode("append").parquet(place)
    return found.unionByName(spark.read.schema(FOOTER).parquet(place)) if exists(spark, place) else found


def read_groups(files: DataFrame) -> DataFrame:
    """view, columns, paths, fault of files (view, folder, path): what can be read with one schema, by view.

    A folder whose files all have the same columns is named as a whole, so that the paths follow the folders and not
    the files. A view of which a file is no Parquet has that as its fault.
    """
    files = written(files.select("view", "folder", "path"), "files")
    seen = files.join(footers(files), "path")
    one = seen.groupBy("folder").agg(F.count_distinct("columns").alias("n"), F.count("fault").alias("faults"))
    place = F.when((F.col("n") == 1) & (F.col("faults") == 0), F.col("folder")).otherwise(F.col("path"))
    faults = seen.groupBy("view").agg(F.max("fault").alias("fault"))
    return seen.join(one, "folder").groupBy("view", "columns").agg(F.sort_array(F.collect_set(place)).alias("paths")).join(faults, "view")


def read_tree(spark: SparkSession, root: str, groups: list[list[str]]) -> DataFrame:
    """The Parquet files of groups of paths under ``root``, each of one schema, united by name."""
    return union_by_name([spark.read.option("basePath", root).parquet(*paths) for paths in groups])


def mount_views(spark: SparkSession, root: str) -> list[str]:
    """A temporary view for each deepest chain of partition keys under ``root``, and one for each file outside of any.

    Files of one chain of keys are one view, united by name with widening, whatever lies between. A view is named
    by the first folder under ``root`` (by ``root`` itself where its partitions begin at once) and the keys' values;
    a file outside of any partition by its own name. Of files that would get one name the first stays. Can be called again:
    what is new is seen, what is there stays. A tree that cannot be read is left out.
    """
    fs, path = file_system(spark, root)
    if not fs.exists(path):
        return []
    under = relative(F.col("path"), root)
    own = root.rstrip("/").rsplit("/", 1)[-1]
    first = F.when(F.instr(under, "/") > 0, F.substring_index(under, "/", 1))
    tree = F.when(first.isNull() | first.contains("="), F.lit(own)).otherwise(first)
    prefix = functools.reduce(lambda c, known: F.when(tree == known[0], F.lit(known[1])).otherwise(c), PREFIXES.items(), tree)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.parquet$", "")
    inside = F.size(partition_map(under)) > 0
    view = F.when(inside, view_name(under, prefix)).otherwise(F.translate(name, "-.", "__"))
    files = inventory(spark, root).select(view.alias("view"), inside.alias("inside"), F.regexp_extract("path", FOLDER, 1).alias("folder"), "path")
    loose = files.where("not inside").groupBy("view").agg(F.min("path").alias("path"))  # a file is a view by itself
    alone = loose.select("view", F.col("path").alias("folder"), "path").join(files.where("inside").select("view").distinct(), "view", "left_anti")
    groups = read_groups(files.where("inside").select("view", "folder", "path").unionByName(alone))
    made = []
    for r in groups.groupBy("view").agg(F.collect_list("paths").alias("groups"), F.max("fault").alias("fault")).orderBy("view").toLocalIterator():  # a row a view
        try:
            if r["fault"]:
                raise ValueError(r["fault"])
            read_tree(spark, root, r["groups"]).createOrReplaceTempView(r["view"])
            made.append(r["view"])
        except Exception as e:  # noqa: BLE001 - one bad tree must not hide the others
            print(f"not mounted: {r['view']}: {e}")
    return made


def partition_span(spark: SparkSession, root: str) -> DataFrame:
    """first_day, last_day, days of the date= partitions; stray 1970-01-01 ones do not count."""
    day = F.regexp_extract("path", r"date=(\d{4}-\d{2}-\d{2})", 1)
    days = inventory(spark, root).select(day.alias("day")).where("day <> '' and day <> '1970-01-01'")
    return days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("day").alias("days"))


def freshness(span: DataFrame, freshness_days: int, today: Column | None = None) -> DataFrame:
    """days_behind and fresh, from a partition_span."""
    behind = F.datediff(today if today is not None else F.current_date(), F.col("last_day").cast("date"))
    return span.withColumns({"days_behind": behind, "fresh": behind <= freshness_days})


def sample_json(df: DataFrame, n: int = 20) -> list[str]:
    """The first ``n`` rows as JSON records."""
    return df.limit(n).toJSON().collect()


def layout(spark: SparkSession, root: str) -> DataFrame:
    """chain and its tables, at whatever depth: the last two plain folders before the first key=value."""
    plain = F.regexp_extract(relative(F.col("path"), root), r"^((?:[^/=]+/)+)", 1)
    parts = F.split(F.rtrim(plain, F.lit("/")), "/")
    return (
        inventory(spark, root).select(parts.alias("parts")).where(F.size("parts") >= 2)
        .groupBy(F.element_at("parts", -2).alias("chain")).agg(F.sort_array(F.collect_set(F.element_at("parts", -1))).alias("tables"))
    )


def describe(spark: SparkSession, path: str) -> DataFrame:
    """name and type of a dataset's columns, from its footers."""
    schema = spark.read.parquet(path).schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "name string, type string")


def segments(paths: DataFrame, column: str = "path") -> DataFrame:
    """One row a key=value segment of each path."""
    return paths.select(column, F.explode(partition_map(F.col(column))).alias("key", "value"))
