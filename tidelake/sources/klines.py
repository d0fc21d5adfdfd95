"""Zipped kline archives: headerless CSV in the first member of each zip."""

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_to_timestamp
from ..operators import write as layers
from ..scratch import children, delete, file_system, new_path

#: Fixed value: the twelve columns of the format, in order.
COLUMNS = (
    "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, "
    "trade_count bigint, taker_buy_volume double, taker_buy_quote_volume double, ignore string"
)

#: Fixed value: rows that a task sorts, about 160 bytes of memory each; a month of more is as many files.
SORT_ROWS = 2_000_000


def _blocks(content: bytes) -> Iterator[list[str]]:
    """The lines of an archive's first member, a block at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
        block = []
        for line in io.TextIOWrapper(f, "utf-8"):
            if line := line.strip():
                block.append(line)
            if len(block) >= 50_000:
                yield block
                block = []
        if block:
            yield block


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of each archive's first member."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            for block in _blocks(content):
                yield pd.DataFrame({"path": path, "line": block})


def _tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines by place; an archive that cannot be read is told, so that those of other places stay."""
    for batch in batches:
        for place, content in zip(batch["place"], batch["content"], strict=True):
            try:
                for block in _blocks(content):
                    yield pd.DataFrame({"place": place, "line": block, "fault": None})
            except Exception as e:  # noqa: BLE001 - whatever is wrong with it
                yield pd.DataFrame({"place": [place], "line": [None], "fault": [f"{type(e).__name__}: {e}"]})


def _typed(lines: DataFrame, *keep: str) -> DataFrame:
    rows = lines.select(*keep, F.from_csv("line", COLUMNS).alias("k")).select(*keep, "k.*")
    return rows.withColumns({c: epoch_to_timestamp(F.col(c)) for c in ("open_time", "close_time")}).drop("ignore")


def parse(archives: DataFrame) -> DataFrame:
    """Klines of zips (path, content): typed, times normalised; sort on write."""
    return _typed(archives.select("path", "content").mapInPandas(_lines, "path string, line string"))


def read(spark: SparkSession, archives: str, symbol: str, interval: str) -> DataFrame:
    """Klines of all zips that ``archives`` names, tagged."""
    return parse(spark.read.format("binaryFile").load(archives)).withColumns({"symbol": F.lit(symbol), "interval": F.lit(interval)})


def _zips(spark: SparkSession, path: str) -> list[str] | None:
    """The zips of an archive, which is one or a folder of them, by the names that Spark gives them; None if it is not there."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    found, files, base = [], fs.listFiles(p, True), fs.getFileStatus(p).getPath().toString()
    while files.hasNext():
        found.append(files.next().getPath().toString())
    hidden = lambda name: name.startswith(".") or name.startswith("_") and "=" not in name  # noqa: E731 - as Spark hides them
    return [f for f in found if not any(map(hidden, f.removeprefix(base).split("/")))]


def _put(spark: SparkSession, pieces: list[tuple[str, int]], targets: list[str], out: str) -> None:
    """Parse all zips (path, number of its target) at once, sort the rows of each target, count, and only then put them into place."""
    faults, names = {}, set()
    parsed, aside = new_path(spark, "klines"), f"{out}/_staging-{uuid.uuid4().hex}"
    if pieces:
        archives = spark.read.format("binaryFile").load(sorted({path for path, _ in pieces})).select("path", "content")
        placed = archives.join(F.broadcast(spark.createDataFrame(pieces, "path string, place int")), "path").select("place", "content")
        _typed(placed.mapInPandas(_tried, "place int, line string, fault string"), "place", "fault").write.parquet(parsed)
        rows = spark.read.parquet(parsed)
        faults = dict(rows.where("fault is not null").groupBy("place").agg(F.min("fault")).collect())
        rows = (rows.where(~F.col("place").isin(list(faults))) if faults else rows).drop("fault")
        if made := rows.count():
            layers.write(rows, aside, ["place"], "open_time", files=-(-made // SORT_ROWS))
            if (there := spark.read.parquet(aside).count()) != made:
                raise RuntimeError(f"{made} rows were parsed, {there} are in {aside}; not published")
        names = set(children(spark, aside))
    for k, target in enumerate(targets):
        if f"place={k}" in names:
            delete(spark, target)  # a folder without files is what a broken load has left
            fs, p = file_system(spark, target)
            fs.mkdirs(p.getParent())
            if not fs.rename(file_system(spark, f"{aside}/place={k}")[1], p):
                raise OSError(f"could not publish {target}")
    delete(spark, aside)
    delete(spark, parsed)
    if odd := [f"{faults.get(k, '0 rows')} for {target}" for k, target in enumerate(targets) if f"place={k}" not in names]:
        raise ValueError(f"{'; '.join(odd)}; not published")


def load(spark: SparkSession, months: list[tuple[str, str]], symbol: str, interval: str, out: str) -> DataFrame:
    """Load (month, archive path) pairs that are not there yet; month and status of each. An archive is a zip, or a folder of zips.

    Written as symbol=/interval=/date= partitions of zstd files sorted by time; a second run writes nothing. Zips are parsed by as many
    tasks as there are, and a month of many rows is sorted by several tasks. A month is put into place whole, so that one whose load broke
    off is loaded again; what such a load has left beside it is hidden from readers. Months whose archive is broken or empty are an
    error once the others are in place.
    """
    status, pieces, targets = [], [], []
    for month, archive in months:
        target = f"{out}/symbol={symbol}/interval={interval}/date={month}"
        if target in targets or any(name.endswith(".parquet") for name in children(spark, target)):
            status.append((month, "skipped"))
        elif (zips := _zips(spark, archive)) is None:
            status.append((month, "missing"))
        else:
            pieces += [(path, len(targets)) for path in zips]
            targets.append(target)
            status.append((month, "written"))
    if targets:
        _put(spark, pieces, targets, out)
    return spark.createDataFrame(status, "month string, status string")
