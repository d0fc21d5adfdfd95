"""Draining and watching sources with exact restart: pages arrive as files, Spark's checkpoint is the cursor."""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..scratch import file_system

FLUSH_ROWS, FLUSH_BYTES = 500_000, 200 * 1024**2


def drained(q: StreamingQuery, deadline_s: float | None = None) -> tuple[str, int]:
    """Wait for a query: why it ended, and how many rows it read.

    Progress is taken up while the query runs, batch by batch, since Spark only keeps the newest hundred reports.
    """
    end = time.monotonic() + deadline_s if deadline_s else None
    rows: dict[int, int] = {}
    reason = "exhausted"
    while True:
        over = q.awaitTermination(0.5)
        rows |= {p["batchId"]: max(p["numInputRows"], rows.get(p["batchId"], 0)) for p in q.recentProgress}
        if over:
            return reason, sum(rows.values())
        if end and time.monotonic() > end:
            q.stop()
            end, reason = None, "deadline"


def pump(
    spark: SparkSession, pages: str, schema: T.StructType, checkpoint: str, sink: Callable[[DataFrame, int], None],
    pages_per_batch: int = 1, deadline_s: float | None = None,
) -> dict:
    """Give every page file to ``sink``, at least once: the sink goes first, then the cursor moves, so that after a failure between
    the two the same pages come again under the same batch number.

    Runs until the pages there now are drained, or the deadline. A later call goes on behind the last page;
    an error in the sink leaves the cursor where it was. Returns why it stopped, and the rows and batches that the sink took.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", pages_per_batch).parquet(pages)
    given = {"rows": 0, "batches": 0}

    def deliver(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        given["rows"] += batch.count()  # of Parquet pages, from their footers
        given["batches"] += 1

    q = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    reason, _ = drained(q, deadline_s)
    return given | {"reason": reason}


def pump_to(spark: SparkSession, pages: str, schema: T.StructType, checkpoint: str, out: str, pages_per_batch: int = 4) -> dict:
    """Drain pages to Parquet files, exactly once: Spark's file sink commits files and cursor together."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", pages_per_batch).parquet(pages)
    writer = stream.writeStream.format("parquet").option("path", out).option("compression", "zstd")
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return {"rows": drained(q)[1]}


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"

#: A batch of a watch takes files of so many bytes, and at least one file. A partition of state is opened and committed in each batch, which takes
#: about 0.2 s whatever it holds: so there are two a core, no fewer than these (a cluster may still be growing), if the session does not ask for fewer.
BATCH_BYTES, LEAST_PARTITIONS = 512 * 1024**2, 32


def watch(
    spark: SparkSession, visits: str, schema: T.StructType, checkpoint: str, out: str, id_column: str, time_column: str, remember_s: int | None = None,
    partitions: int | None = None,
) -> dict:
    """Store each id once, however often and however late it comes; also within one visit.

    The seen ids are Spark's state, kept with the checkpoint, on disk by RocksDB. By default that is exact deduplication, and no event-time
    watermark is set, since one drops late rows that have not been seen: the state grows with the ids. With ``remember_s`` an id is forgotten, not
    before so many seconds after it was stored, at the next batch: the state is bounded by the ids that come in
    that time, and one that comes again later is stored again. The watermark for that is the time of arrival, which no row can be late for.
    The two keep different states: a checkpoint goes on with the one it began with, and with its ``partitions``, which are to be given where
    the state will be far larger than what this cluster's cores take. Returns fetched, stored, the resume point, which never goes back, and of the state the ids it knows and its bound.
    """
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(visits)
    before = {name: spark.conf.get(name) for name in (PROVIDER, PARTITIONS)}
    most = max(LEAST_PARTITIONS, 2 * spark.sparkContext.defaultParallelism)
    own = {PROVIDER: ROCKS, PARTITIONS: str(partitions or min(int(before[PARTITIONS]), most))}
    if remember_s is None:
        once = stream.dropDuplicates([id_column])
    else:
        # an id lives until the watermark, which is behind by the delay, has passed its arrival by the delay
        arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", f"{-(-remember_s // 2)} seconds")
        once = arrived.dropDuplicatesWithinWatermark([id_column]).drop("_arrived")
    writer = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        q = writer.trigger(availableNow=True).start()
        _, fetched = drained(q)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    known = sum(o.numRowsTotal for o in q.lastProgress.stateOperators) if q.lastProgress else None
    kept = spark.read.schema(schema).parquet(out).agg(F.count(F.lit(1)), F.max(time_column)).first()
    return {"fetched": fetched, "stored": kept[0], "watermark": kept[1], "known": known, "remember_s": remember_s}


def unseen(batch: DataFrame, seen: DataFrame, id_column: str) -> DataFrame:
    """The rows of ids that ``seen`` lacks, once each."""
    return batch.join(seen.select(id_column), id_column, "left_anti").dropDuplicates([id_column])


def resume_point(batch: DataFrame, time_column: str, before):
    """The greatest time seen, compared by type and never less than ``before``."""
    new = batch.agg(F.max(time_column)).first()[0]
    return before if new is None or before is not None and new < before else new


def buffered_append(
    spark: SparkSession, records: str, schema: T.StructType, checkpoint: str, out: str, time_column: str, every: str | None = None
) -> list[dict]:
    """Append records in sorted files; rows that are null throughout are dropped. A report of each flush.

    Flushes what has arrived (``every`` None), or at each interval. A flush is dealt to ranges of time of about
    FLUSH_ROWS rows, one file each. Files under FLUSH_BYTES on average are reported as undersized.
    """
    reports: list[dict] = []

    def flush(batch: DataFrame, number: int) -> None:
        path = f"{out}/part={number}"
        rows = batch.dropna("all")
        n = batch.count()  # from the footers
        files = max(1, -(-n // FLUSH_ROWS))
        dealt = rows.repartitionByRange(files, time_column).sortWithinPartitions(time_column)
        dealt.write.mode("overwrite").option("compression", "zstd").parquet(path)
        fs, p = file_system(spark, path)
        size = fs.getContentSummary(p).getLength()
        written = spark.read.schema(schema).parquet(path).count()
        reports.append({"batch": number, "rows": written, "bytes": size, "undersized": size / files < FLUSH_BYTES})

    stream = spark.readStream.schema(schema).parquet(records)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    q = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if not every:
        q.awaitTermination()
    return reports
