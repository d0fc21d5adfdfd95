"""Draining a paged source: a streaming data source whose offset is the page cursor.

A page source tells for a position how many records its page has and which position comes next (``peek``), and gives the
page's rows (``fetch``). Positions are looked up one after another when a batch is planned; the pages of a batch are fetched by as many tasks.
Spark's checkpoint is the cursor: a batch's pages go to the sink first, then the cursor moves, so that every page is delivered at least once,
and once exactly where the sink takes the number of a batch into account.
"""

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple, Protocol

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..scratch import file_system

#: Fixed value: no wait for a source is longer, whatever it asks for.
MOST_WAIT_S = 60.0
LIMITED = "the source still refuses after"


class RateLimited(Exception):
    """What a page source raises where it is to be asked again later."""

    def __init__(self, retry_after: float = 1.0):
        super().__init__(f"asked to wait {retry_after} s")
        self.retry_after = retry_after


class GivenUp(RuntimeError):
    """A source has asked to wait more often than it may."""


class Page(NamedTuple):
    records: int
    following: Any  # the next page's position, None behind the last


class Pages(Protocol):
    """Positions are numbers, strings or lists of them."""

    first: Any

    def peek(self, position: Any) -> Page: ...

    def fetch(self, position: Any) -> Iterator[tuple]: ...


@dataclass(frozen=True)
class FetchedPages:
    """Pages of a source that tells its next position only with the rows: ``get`` gives both, and is asked twice for a page."""

    get: Callable[[Any], tuple[list[tuple], Any]]
    first: Any = 0

    def peek(self, position: Any) -> Page:
        rows, following = self.get(position)
        return Page(len(rows), following)

    def fetch(self, position: Any) -> Iterator[tuple]:
        return iter(self.get(position)[0])


def patiently(call: Callable, retries: int, sleep: Callable[[float], None] = time.sleep):
    """``call()``, again after each refusal as long as the source asks to wait, ``retries`` times at most."""
    for k in range(retries + 1):
        try:
            return call()
        except RateLimited as e:
            if k == retries:
                raise GivenUp(f"{LIMITED} {retries} retries") from e
            sleep(min(max(0.0, e.retry_after), MOST_WAIT_S))


@dataclass
class _PageRange(InputPartition):
    position: str


class _Reader(DataSourceStreamReader):
    """Offsets: the next page's position as JSON, pages and records so far, whether there is a next page, which call of the pump
    made it, and why that call ends there."""

    def __init__(self, pages: Pages, options: dict):
        self.pages, self.options = pages, options
        self.retries = int(options["retries"])
        self.at = json.loads(options["start"]) if "start" in options else self.initialOffset()
        self.start, self.call = self.at, self.at["call"] + 1
        self.chain: dict[int, tuple[str, dict]] = {}  # by pages before it: a page's position, and the offset behind it

    def initialOffset(self) -> dict:
        return {"position": json.dumps(self.pages.first), "pages": 0, "records": 0, "exhausted": False, "call": 0, "stop": ""}

    def _behind(self, offset: dict) -> dict:
        """The offset behind the page at ``offset``."""
        if offset["pages"] not in self.chain:
            page = patiently(lambda: self.pages.peek(json.loads(offset["position"])), self.retries)
            after = {"position": json.dumps(page.following), "pages": offset["pages"] + 1, "records": offset["records"] + page.records}
            self.chain[offset["pages"]] = (offset["position"], after | {"exhausted": page.following is None, "call": self.call, "stop": ""})
        return self.chain[offset["pages"]][1]

    def _bound(self, at: dict) -> str:
        """Why this call must not go on from ``at``; none if it may."""
        if at["exhausted"]:
            return "exhausted"
        for name in ("pages", "records"):
            most = self.options.get(f"max_{name}")
            if most is not None and at[name] - self.start[name] >= int(most):
                return f"max_{name}"
        return ""

    def latestOffset(self) -> dict:
        if self.at["call"] == self.call and self.at["stop"]:
            return self.at
        at = self.at | {"call": self.call, "stop": ""}  # differs from where the last call ended, so that a batch tells why this one does
        for _ in range(int(self.options["pages_per_batch"])):
            if at["stop"] or self._bound(at):
                break
            try:
                at = dict(self._behind(at))
            except GivenUp:
                at = at | {"stop": "rate_limited"}
        self.at = at | {"stop": at["stop"] or self._bound(at)}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found, at = [], start
        while at["pages"] < end["pages"]:
            found.append(_PageRange(at["position"]))
            at = self._behind(at)
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return patiently(lambda: self.pages.fetch(json.loads(partition.position)), self.retries)

    def commit(self, end: dict) -> None:
        self.chain = {k: v for k, v in self.chain.items() if k >= end["pages"]}


def page_stream(spark: SparkSession, pages: Pages, schema: str | T.StructType, **options) -> DataFrame:
    """A streaming DataFrame of a page source; options: start (an offset as JSON), pages_per_batch, max_pages, max_records, retries."""
    kind = f"pages_{uuid.uuid4().hex}"

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self):
            return schema

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(pages, dict(self.options))

    spark.dataSource.register(Paged)
    return spark.readStream.format(kind).options(**{k: str(v) for k, v in ({"pages_per_batch": 1, "retries": 5} | options).items() if v is not None}).load()


def _logged(spark: SparkSession, checkpoint: str, kind: str) -> list[int]:
    """Numbers of the batches that a checkpoint has as planned (kind: offsets) or delivered (commits)."""
    fs, folder = file_system(spark, f"{checkpoint}/{kind}")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []


def _offset(spark: SparkSession, checkpoint: str, batch: int) -> dict:
    """The offset behind a planned batch: the last line of its entry in the checkpoint."""
    lines = spark.read.text(f"{checkpoint}/offsets/{batch}", wholetext=True).first()[0].strip().split("\n")
    return json.loads(lines[-1])


NOTHING = {"pages": 0, "records": 0, "call": 0}
CURSOR = "batch long, position string, pages long, records long, exhausted boolean, stop string"


def cursor_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """A row for each delivered batch that the checkpoint still knows: where it ended, pages and records in all, and why a call ended there."""
    rows = [(k, _offset(spark, checkpoint, k)) for k in _logged(spark, checkpoint, "commits")]
    return spark.createDataFrame([(k, o["position"], o["pages"], o["records"], o["exhausted"], o["stop"]) for k, o in rows], CURSOR)


def cursor(spark: SparkSession, checkpoint: str) -> dict | None:
    """Where the last delivered batch ended; None if there is none."""
    done = _logged(spark, checkpoint, "commits")
    return _offset(spark, checkpoint, done[-1]) if done else None


def pump_pages(
    spark: SparkSession, pages: Pages, schema: str | T.StructType, checkpoint: str, sink: Callable[[DataFrame, int], None], max_pages: int | None = None,
    max_records: int | None = None, deadline_s: float | None = None, pages_per_batch: int = 1, retries: int = 5,
) -> dict:
    """Drain a page source into ``sink`` from where the last call ended, until a bound is reached: status, pages and records of this call, cursor.

    status: exhausted, max_pages, max_records, deadline, rate_limited (after ``retries`` refusals in a row of one page), or already_exhausted,
    which asks the source nothing. Bounds are looked at before each page, so that the page that reaches ``max_records`` is the last; the deadline
    before each batch. An error in the source or the sink is raised and leaves the cursor where it was.
    """
    planned = _logged(spark, checkpoint, "offsets")
    before = cursor(spark, checkpoint)
    done = before or NOTHING
    if before and before["exhausted"]:
        return {"status": "already_exhausted", "pages": 0, "records": 0, "cursor": before}
    start = json.dumps(_offset(spark, checkpoint, planned[-1])) if planned else None  # what was planned is delivered first
    stream = page_stream(spark, pages, schema, start=start, max_pages=max_pages, max_records=max_records, pages_per_batch=pages_per_batch, retries=retries)
    end, status = time.monotonic() + deadline_s if deadline_s is not None else None, ""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        while not status and not q.awaitTermination(0.1):
            told = json.loads(q.lastProgress.json)["sources"][0]["endOffset"] if q.lastProgress else None
            status = told["stop"] if told and told["call"] > done["call"] else ""
            if not status and end is not None and time.monotonic() >= end:
                status = "deadline"
    except StreamingQueryException as e:
        if LIMITED not in str(e):
            raise
        status = "rate_limited"
    finally:
        q.stop()
    now = cursor(spark, checkpoint) or NOTHING
    return {"status": status, "pages": now["pages"] - done["pages"], "records": now["records"] - done["records"], "cursor": now}


class ParquetPages:
    """The Parquet files under a folder in the order of their paths, a page each, read by tasks through Arrow's file systems."""

    first = 0

    def __init__(self, spark: SparkSession, folder: str):
        fs, path = file_system(spark, folder)
        found, files = [], fs.listFiles(path, True)
        while files.hasNext():
            found.append(files.next().getPath().toString())
        self.files = [f if "://" in f else "file://" + f.removeprefix("file:") for f in sorted(found) if f.endswith(".parquet")]

    def _open(self, position: int):
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(self.files[position])
        return pq.ParquetFile(store.open_input_file(name))

    def peek(self, position: int) -> Page:
        return Page(self._open(position).metadata.num_rows, position + 1 if position + 1 < len(self.files) else None)

    def fetch(self, position: int) -> Iterator[tuple]:
        for batch in self._open(position).iter_batches():
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
