"""Compaction of small files: plan, rewrite, verify, publish, delete."""

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import children, delete, file_system, get_text, put_text, written
from ..sources.discovery import footers, inventory, read_groups, union_by_name
from .write import GOAL_BYTES, LEAST_BYTES, MIB, MOST_BYTES

COMPACTED = "compacted-"

#: Bytes of files that one task sorts: a group of more is sorted in ranges of time, by a task each, and one more task puts these in a row.
SORT_BYTES = 64 * MIB


def plan(spark: SparkSession, root: str, least: int = LEAST_BYTES, most: int = MOST_BYTES) -> DataFrame:
    """folder, part, path, length: files under ``least`` in groups of at most ``most`` bytes, in path order, folder by folder.

    A group of one stays as it is.
    """

    def fold(files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values("path")
        part, total, parts = 0, 0, []
        for n in files["length"]:
            if total and total + n > most:
                part, total = part + 1, 0
            total += n
            parts.append(part)
        return files.assign(part=parts)[["folder", "part", "path", "length"]]

    small = inventory(spark, root).where(F.col("length") < least).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "path", "length")
    return small.groupBy("folder").applyInPandas(fold, "folder string, part int, path string, length long")


def compact_group(spark: SparkSession, paths: list[str], time: str, dry_run: bool = False, count=lambda df: df.count()) -> dict:
    """Rewrite files of one folder as one, sorted by ``time``. Inputs go only after the new file has been read back whole.

    Columns of one name may differ in type, and are widened; their names must agree.
    """
    if len(paths) < 2:
        raise ValueError("a group has two files or more")
    folders = {p.rsplit("/", 1)[0] for p in paths}
    if len(folders) > 1:
        raise ValueError("a group lies in one folder")
    files = spark.createDataFrame([(p,) for p in paths], "path string").select(F.lit("").alias("view"), F.col("path").alias("folder"), "path")
    kinds = read_groups(files).collect()  # one for each set of columns
    if faults := [r["fault"] for r in kinds if r["fault"]]:
        raise ValueError(faults[0])
    frames = [spark.read.parquet(*r["paths"]) for r in kinds]
    if any(set(f.columns) != set(frames[0].columns) for f in frames):
        raise ValueError("the files' columns differ")
    rows = union_by_name(frames)
    before = rows.count()
    report = {"files": len(paths), "rows": before, "dry_run": dry_run}
    if dry_run:
        return report
    folder = folders.pop()
    aside = f"{folder}/_compacting-{uuid.uuid4().hex}"
    fs, staging = file_system(spark, aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    whole = f"{aside}/whole"
    pieces = -(-sum(fs.getFileStatus(path(p)).getLen() for p in paths) // SORT_BYTES)
    (_in_pieces(rows, time, pieces, f"{aside}/pieces") if pieces > 1 else rows.coalesce(1).sortWithinPartitions(time)).write.option("compression", "zstd").parquet(whole)
    back = spark.read.parquet(whole)
    if count(back) != before or set(back.columns) != set(frames[0].columns):
        fs.delete(staging, True)
        raise RuntimeError("the new file does not hold what the old ones held; nothing was deleted")
    made = [s.getPath() for s in fs.listStatus(path(whole)) if s.getPath().getName().endswith(".parquet")]
    for k, m in enumerate(made):
        if not fs.rename(m, path(f"{folder}/{COMPACTED}{uuid.uuid4().hex}-{k}.parquet")):
            raise OSError("could not publish the new file; nothing was deleted")
    for p in paths:
        fs.delete(path(p), False)
    fs.delete(staging, True)
    return report


def _in_pieces(rows: DataFrame, time: str, pieces: int, aside: str) -> DataFrame:
    """``rows`` in the order of ``time`` and one partition: sorted in ranges, a task and a file each under ``aside``, and read back one behind the other.

    Rows of one time are dealt by their content, so that a time with most rows is no single range.
    """
    spark = rows.sparkSession
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]  # which have no hash
    dealt = rows.repartitionByRange(pieces, F.col(time), F.xxhash64(time, *plain)).withColumn(PIECE, F.spark_partition_id())
    dealt.sortWithinPartitions(PIECE, time).write.option("compression", "zstd").partitionBy(PIECE).parquet(aside)
    numbers = sorted(int(n.split("=")[1]) for n in children(spark, aside) if n.startswith(f"{PIECE}="))
    names = [f"{aside}/{PIECE}={k}/{n}" for k in numbers for n in children(spark, f"{aside}/{PIECE}={k}") if n.endswith(".parquet")]
    return reduce(DataFrame.union, [spark.read.schema(rows.schema).parquet(n) for n in names]).coalesce(1)


GROUP, FILE, PIECE = "_compacting", "_compacting_file", "_compacting_piece"


def _groups(spark: SparkSession, root: str, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The files of all groups of two files or more (path, columns, group), and the groups: folder, files, rows, bytes, kind (their files' columns), fault."""
    files = plan(spark, root, least, most).withColumn("group", F.concat_ws("/", "folder", "part"))
    files = written(files, "plan")
    many = files.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    told = written(files.join(many, "group").join(footers(files), "path"), "planned")
    groups = told.groupBy("group", "folder").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("length").alias("bytes"), F.md5(F.concat_ws("\n", F.array_sort(F.collect_set("columns")))).alias("kind"),
        F.coalesce(F.max("fault"), F.when(F.count_distinct("names") > 1, "the files' columns differ")).alias("fault"),
    )
    return told.select("path", "columns", "group"), written(groups, "groups")


def _rewrite(spark: SparkSession, files: DataFrame, time: str, staging: str) -> dict[str, int]:
    """Write all groups' files (path, columns, group) in one job, a task and a file a group; the rows that are read back of each."""
    rows = files.collect()
    by_columns: dict[str, list[str]] = {}
    for r in rows:
        by_columns.setdefault(r["columns"], []).append(r["path"])
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    frames = [spark.read.parquet(*paths) for paths in by_columns.values()]
    frames = [f.withColumn(FILE, plain(F.col("_metadata.file_path"))) for f in frames]
    of_file = files.select(plain(F.col("path")).alias(FILE), F.md5("group").alias(GROUP))  # at most files_per_job rows
    groups = len({r["group"] for r in rows})
    dealt = union_by_name(frames).join(F.broadcast(of_file), FILE).drop(FILE).repartition(groups, GROUP).sortWithinPartitions(GROUP, time)
    dealt.write.option("compression", "zstd").partitionBy(GROUP).parquet(staging)
    back = spark.read.parquet(staging).groupBy(GROUP).agg(F.count(F.lit(1)).alias("rows"))
    return {r[GROUP]: r["rows"] for r in back.collect()}


def compact(
    spark: SparkSession, root: str, time: str, least: int = LEAST_BYTES, most: int = MOST_BYTES, at_once: int = 16, files_per_job: int = 50_000,
    rewrite=_rewrite,
) -> dict:
    """Rewrite every group of a tree as one file, sorted by ``time``: totals, the jobs that wrote, and the groups that failed, with why.

    Groups whose files have the same columns are rewritten together, by one job for about ``files_per_job`` files: a group is the key of
    its shuffle; one of more than SORT_BYTES is rewritten by jobs of its own, ``at_once`` of them together. The rows of each new file are counted and held against the footers of the old ones before it is put beside them and they are deleted. A group
    whose files are no Parquet or differ in their columns' names fails alone; where a job fails, its groups are tried one by one.
    """
    files, groups = _groups(spark, root, least, most)
    failed = [(r["folder"], r["fault"]) for r in groups.where("fault is not null").select("folder", "fault").toLocalIterator()]
    sound = groups.where("fault is null")
    done = {"groups": 0, "files": 0, "rows": 0, "jobs": 0}
    for kind in sound.groupBy("kind").agg(F.sum("files").alias("files")).collect():  # a row for each mix of columns
        waves = -(-kind["files"] // files_per_job)
        for wave in range(waves):
            own = sound.where((F.col("kind") == kind["kind"]) & (F.pmod(F.xxhash64("group"), F.lit(waves)) == wave))
            reports, faults = _wave(spark, root, files, own, time, at_once, rewrite)
            failed += faults
            done["jobs"] += 1
            for name in ("files", "rows"):
                done[name] += sum(r[name] for r in reports)
            done["groups"] += len(reports)
    return done | {"failed": failed}


def _wave(spark: SparkSession, root: str, files: DataFrame, groups: DataFrame, time: str, at_once: int, rewrite) -> tuple[list[dict], list[tuple[str, str]]]:
    mine = written(files.join(groups.select("group", (F.col("bytes") > SORT_BYTES).alias("large")), "group"), "wave")
    paths: dict[str, list[str]] = {}
    for r in mine.select("group", "path").collect():
        paths.setdefault(r["group"], []).append(r["path"])
    told = groups.select("group", "folder", "rows", (F.col("bytes") > SORT_BYTES).alias("large"), F.md5("group").alias("name")).collect()
    staging = f"{root.rstrip('/')}/_compacting-{uuid.uuid4().hex}"
    fs, staged = file_system(spark, staging)
    path = spark._jvm.org.apache.hadoop.fs.Path

    def alone(group) -> dict:
        return compact_group(spark, paths[group["group"]], time)

    def publish(group) -> dict:
        if group["large"]:
            return alone(group)
        if back.get(group["name"], 0) != group["rows"]:
            raise RuntimeError("the new file does not hold what the old ones held; nothing was deleted")
        made = [s.getPath() for s in fs.listStatus(path(f"{staging}/{GROUP}={group['name']}")) if s.getPath().getName().endswith(".parquet")]
        for k, m in enumerate(made):
            if not fs.rename(m, path(f"{group['folder']}/{COMPACTED}{uuid.uuid4().hex}-{k}.parquet")):
                raise OSError("could not publish the new file; nothing was deleted")
        for p in paths[group["group"]]:
            fs.delete(path(p), False)
        return {"files": len(paths[group["group"]]), "rows": group["rows"]}

    try:
        small = any(not g["large"] for g in told)
        back, each = rewrite(spark, mine.where("not large").drop("large"), time, staging) if small else {}, publish
    except Exception as e:  # noqa: BLE001 - one group's data must not keep the others back
        print(f"compacting one by one: {str(e)[:200]}")
        each = alone

    def one(group) -> tuple[dict | None, tuple[str, str] | None]:
        try:
            return each(group), None
        except Exception as e:  # noqa: BLE001 - reported with the totals
            return None, (group["folder"], str(e)[:300])

    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(one, told))
    fs.delete(staged, True)
    return [r for r, _ in done if r], [f for _, f in done if f]


def pending(spark: SparkSession, root: str, least: int = LEAST_BYTES) -> int:
    """Bytes in small files that no compaction has made."""
    name = F.element_at(F.split("path", "/"), -1)
    small = inventory(spark, root).where((F.col("length") < least) & ~name.startswith(COMPACTED))
    return small.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def _waiting(spark: SparkSession, ledger: str, number: int) -> int | None:
    """What waited behind the newest batch before ``number``; None if no batch has told."""
    told = [int(n) for n in children(spark, ledger) if n.isdigit() and int(n) < number]
    text = get_text(spark, f"{ledger}/{max(told)}") if told else ""
    return int(text) if text else None


def watch(spark: SparkSession, root: str, checkpoint: str, time: str, pending_bytes: int = 100 * 1024**2, goal: int = GOAL_BYTES) -> dict:
    """Compact folders whenever files have come and those still small make ``pending_bytes``, however many calls they came in.

    What has come since the last call is Spark's cursor. What waits is a number beside the checkpoint, by batch, so that a batch that comes again
    starts from the same one; the tree is listed at the first batch, and when that number says that a compaction is due, which the
    listing then decides.
    """
    seen, ledger = {"bytes": 0, "files": 0, "compactions": 0}, f"{checkpoint.rstrip('/')}-waiting"

    def arrived(batch: DataFrame, number: int) -> None:
        new = batch.where(~F.col("path").contains(f"/{COMPACTED}"))
        small = F.sum(F.when(F.col("length") < goal, F.col("length")))
        told = new.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1)), F.coalesce(small, F.lit(0))).first()
        seen["bytes"] += told[0]
        seen["files"] += told[1]
        before = _waiting(spark, ledger, number)
        waits = pending(spark, root, goal) if before is None else before + told[2]
        if told[1] and waits >= pending_bytes:
            waits = pending(spark, root, goal)
            if waits >= pending_bytes:
                seen["compactions"] += compact(spark, root, time, goal)["groups"] > 0
                waits = pending(spark, root, goal)
        delete(spark, f"{ledger}/{number}")
        put_text(spark, f"{ledger}/{number}", str(waits))
        delete(spark, f"{ledger}/{number - 2}")

    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    writer = reader.load(root).select("path", "length").writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return seen
