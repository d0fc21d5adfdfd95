"""In-place datasets under date= partitions: prefix scans, budgets and estimates."""

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import file_system
from .discovery import inventory

#: How a date may begin, by its length.
FORMS = {4: "%Y", 7: "%Y-%m", 10: "%Y-%m-%d"}


def checked_prefix(prefix: str) -> str:
    """``prefix`` if it is a year, a month or a day that the calendar has."""
    form = FORMS.get(len(prefix))
    try:
        if form and datetime.datetime.strptime(prefix, form).strftime(form) == prefix:
            return prefix
    except ValueError:
        pass
    raise ValueError(f"a date prefix is a year, a month or a day, such as 2024-01, and not {prefix!r}")


def scan(spark: SparkSession, table_root: str, prefix: str) -> DataFrame:
    """The partitions whose date begins with ``prefix`` (a year, month or day); others are not listed."""
    return spark.read.option("basePath", table_root).parquet(f"{table_root}/date={checked_prefix(prefix)}*")


def cover(first: str, last: str) -> list[str]:
    """The fewest years, months and days whose days are exactly those from ``first`` to ``last``."""
    day, end = (datetime.date.fromisoformat(d) for d in (first, last))
    if day > end:
        raise ValueError(f"{first} is after {last}")
    found, one = [], datetime.timedelta(1)
    while day <= end:
        month_end = (day.replace(day=28) + datetime.timedelta(4)).replace(day=1) - one
        year_end = day.replace(month=12, day=31)
        if day == day.replace(month=1, day=1) and year_end <= end:
            found, day = [*found, f"{day:%Y}"], year_end + one
        elif day.day == 1 and month_end <= end:
            found, day = [*found, f"{day:%Y-%m}"], month_end + one
        else:
            found, day = [*found, f"{day:%Y-%m-%d}"], day + one
    return found


def scan_range(spark: SparkSession, table_root: str, first: str, last: str) -> DataFrame:
    """The partitions from ``first`` to ``last``: one pattern for each part of the range's cover, so that only these folders are listed.

    At most 60 days and 22 months beside the years. A range of which nothing is there is an error, as with scan.
    """
    fs, _ = file_system(spark, table_root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    patterns = [f"{table_root}/date={c}{'' if len(c) == 10 else '-*'}" for c in cover(first, last)]
    there = [p for p in patterns if fs.globStatus(path(p))]
    return spark.read.option("basePath", table_root).parquet(*(there or patterns[:1]))


def view_of(chain: str, table: str, prefix: str) -> str:
    """Fixed value: the name under which queries find a scanned table."""
    return f"s3_{chain}_{table}_{prefix}".replace("-", "_")


def register_all(spark: SparkSession, root: str, tables: list[tuple[str, str]], prefix: str) -> DataFrame:
    """Make a view of each (chain, table) for one prefix; chain, table, view and, where there is none, why.

    The prefix is checked before anything is listed; a table that cannot be read does not keep the others out.
    """
    checked_prefix(prefix)
    rows = []
    for chain, table in tables:
        view, why = view_of(chain, table, prefix), None
        try:
            scan(spark, f"{root}/{chain}/{table}", prefix).createOrReplaceTempView(view)
        except Exception as e:  # noqa: BLE001 - told in the result
            view, why = None, str(e)[:300]
        rows.append((chain, table, view, why))
    return spark.createDataFrame(rows, "chain string, table string, view string, why string")


def days_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day from ``first`` to ``last``; a reversed range is an error."""
    if first > last:
        raise ValueError(f"{first} is after {last}")
    days = "select explode(sequence(cast(:a as date), cast(:b as date), interval 1 day)) as day"
    return spark.sql(days, args={"a": first, "b": last})


def months(first, last):
    """A column: the names of all months from that of ``first`` to that of ``last``, as an array."""
    starts = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return F.transform(starts, lambda m: F.date_format(m, "yyyy-MM"))


def last_months(spark: SparkSession, n: int, today=None) -> DataFrame:
    """The last ``n`` complete months before ``today``, oldest first."""
    today = F.current_date() if today is None else today
    span = months(F.add_months(today, -n), F.add_months(today, -1))
    return spark.range(1).select(F.explode(span).alias("month"))


def preview(spark: SparkSession, table_root: str, first: str, last: str) -> DataFrame:
    """day, files, bytes, present for every day of a range."""
    day = F.regexp_extract("path", r"date=(\d{4}-\d{2}-\d{2})", 1).cast("date")
    files = inventory(spark, table_root).groupBy(day.alias("day"))
    sizes = files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    known = [F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "bytes")]
    return days_between(spark, first, last).join(sizes, "day", "left").select("day", *known, F.col("files").isNotNull().alias("present"))


def within_budget(previewed: DataFrame, done: DataFrame, most_bytes: int) -> DataFrame:
    """The days still to load (``done`` has a column day); refused before reading if they are over the budget."""
    todo = previewed.where("present").join(done, "day", "left_anti")
    total = todo.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if total > most_bytes:
        raise ValueError(f"{total} bytes to read; the budget is {most_bytes}")
    return todo


def estimate(sizes: DataFrame, spans: DataFrame, days: int, columns_fraction: float) -> DataFrame:
    """Gigabytes that a scan of ``days`` would read: total * days / span * fraction; null where unmeasured."""
    share = F.least(F.lit(1.0), days / F.col("span_days")) * columns_fraction
    return spans.join(sizes, ["chain", "table"], "left").select("chain", "table", (F.col("gb") * share).alias("scan_gb"))
