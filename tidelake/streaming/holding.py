"""Appending with a holding folder: what has arrived waits until it is worth a file, by size, age or count.

<out>/_held/batch=<n>         what came in batch n, waiting
<out>/_ledger/held-<n>        its rows, bytes and time of arrival
<out>/part=<n>/               what was flushed when batch n was the newest that waited
<out>/_ledger/flushed-<n>     why, and what it holds; written once part=<n> stands, before what waited is deleted

Every step can be done again: a batch that comes again after a failure overwrites its own folder, and one whose flush is in the ledger
only finishes the deletion. So each record is in one part exactly once.
"""

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..scratch import children, delete, file_system, get_text, put_text

#: What is worth a file.
FLUSH_BYTES, FLUSH_AGE_S, FLUSH_ROWS = 200 * 1024**2, 3600, 500_000
FLUSHES = "part long, reason string, rows long, bytes long, batches int, undersized boolean"


class Holding:
    """The waiting records of one output folder, and when they are flushed. ``clock`` gives the time in seconds."""

    def __init__(
        self, spark: SparkSession, out: str, schema: T.StructType, time_column: str, flush_bytes: int = FLUSH_BYTES, flush_age_s: float = FLUSH_AGE_S,
        flush_rows: int = FLUSH_ROWS, clock: Callable[[], float] = time.time,
    ):
        self.spark, self.out, self.schema, self.time_column = spark, out.rstrip("/"), schema, time_column
        self.flush_bytes, self.flush_age_s, self.flush_rows, self.clock = flush_bytes, flush_age_s, flush_rows, clock

    def _entries(self, kind: str) -> dict[int, dict]:
        names = [n for n in children(self.spark, f"{self.out}/_ledger") if n.startswith(f"{kind}-")]
        texts = {int(n.rsplit("-", 1)[1]): get_text(self.spark, f"{self.out}/_ledger/{n}") for n in names}
        return {n: json.loads(t) for n, t in texts.items() if t}

    def held(self) -> dict[int, dict]:
        """What waits, by batch."""
        return self._entries("held")

    def flushes(self) -> DataFrame:
        """A row a flush."""
        done = self._entries("flushed")
        rows = [(n, d["reason"], d["rows"], d["bytes"], len(d["batches"]), d["undersized"]) for n, d in sorted(done.items())]
        return self.spark.createDataFrame(rows, FLUSHES)

    def _size(self, path: str) -> int:
        fs, p = file_system(self.spark, path)
        return fs.getContentSummary(p).getLength()

    def _forget(self, batches: list[int]) -> None:
        for n in batches:
            delete(self.spark, f"{self.out}/_held/batch={n}")
            delete(self.spark, f"{self.out}/_ledger/held-{n}")

    def arrive(self, batch: DataFrame, number: int) -> None:
        """Take a batch in (for foreachBatch), and flush if something is due. Rows that are null throughout are dropped."""
        done = self._entries("flushed")
        late = [n for n in self.held() if any(n in d["batches"] for d in done.values())]
        self._forget(late)  # a flush that could not finish
        if not any(number in d["batches"] for d in done.values()):
            path = f"{self.out}/_held/batch={number}"
            batch.dropna("all").write.mode("overwrite").option("compression", "zstd").parquet(path)
            rows = self.spark.read.schema(self.schema).parquet(path).count()
            put_text(self.spark, f"{self.out}/_ledger/held-{number}", json.dumps({"rows": rows, "bytes": self._size(path), "at": self.clock()}))
        self.flush_due()

    def due(self) -> str | None:
        """Why what waits should be written now: size, age or count; None if it can wait."""
        held = [d for d in self.held().values() if d["rows"]]
        if not held:
            return None
        if sum(d["bytes"] for d in held) >= self.flush_bytes:
            return "size"
        if self.clock() - min(d["at"] for d in held) >= self.flush_age_s:
            return "age"
        return "count" if sum(d["rows"] for d in held) >= self.flush_rows else None

    def flush_due(self) -> dict | None:
        reason = self.due()
        return self.flush(reason) if reason else None

    def flush(self, reason: str = "explicit") -> dict | None:
        """Write all that waits, sorted by time; None if nothing waits.

        Files have about FLUSH_ROWS rows and at most twice FLUSH_BYTES, whatever bounds tell when to flush: these bounds may be a row, or more
        than a task can sort.
        """
        held = self.held()
        rows = sum(d["rows"] for d in held.values())
        if not rows:
            return None
        part, batches, done = max(held), sorted(held), self._entries("flushed")
        for name in children(self.spark, self.out):  # parts of flushes that did not come to their end
            if name.startswith("part=") and int(name[5:]) not in done:
                delete(self.spark, f"{self.out}/{name}")
        waiting = self.spark.read.schema(self.schema).parquet(*[f"{self.out}/_held/batch={n}" for n in batches])
        files = max(1, round(rows / FLUSH_ROWS), -(-sum(d["bytes"] for d in held.values()) // (2 * FLUSH_BYTES)))
        path = f"{self.out}/part={part}"
        dealt = waiting.repartitionByRange(files, self.time_column).sortWithinPartitions(self.time_column)
        dealt.write.mode("overwrite").option("compression", "zstd").parquet(path)
        size = self._size(path)
        told = {"reason": reason, "rows": rows, "bytes": size, "batches": batches, "undersized": size / files < self.flush_bytes and reason != "size"}
        put_text(self.spark, f"{self.out}/_ledger/flushed-{part}", json.dumps(told))
        self._forget(batches)
        return told


def append_held(holding: Holding, records: str, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Take in the record files that have come since the last call, then flush what is due, also if nothing came; a row for each flush so far."""
    reader = holding.spark.readStream.schema(holding.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = reader.parquet(records).writeStream.foreachBatch(holding.arrive).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    holding.flush_due()
    return holding.flushes()
