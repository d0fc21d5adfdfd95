"""Rollups, windows and usage reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from . import ranges

UP_BYTES, DOWN_BYTES = 750 * 1024**3, 10 * 1024**4


def daily_rollup(df: DataFrame, time: str, value: Column) -> DataFrame:
    return df.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def per_entity(df: DataFrame, entity: str, value: Column, more_than: int) -> DataFrame:
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).where(F.col("n") > more_than)


def positioned(df: DataFrame, order: list, out: str = "position") -> DataFrame:
    """Add ``out``: gapless places from 0 in the order of all rows, without one task that has them all.

    Rows are dealt to ranges and numbered within each; a range starts behind the rows of those before it. The dealt rows are written
    once, so that both passes see the same ranges.
    """
    part, rank, start, n = (f"_{x}_{out}" for x in ("part", "rank", "start", "n"))
    dealt = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(n))  # one row a range
    starts = sizes.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return ranked.join(F.broadcast(starts), part).withColumn(out, F.col(start) + F.col(rank)).select(*df.columns, out)


def rolling_mean(df: DataFrame, key: str, order: list[str], value: str | Column, preceding: int = 100) -> DataFrame:
    """Mean over a row and the ``preceding`` before it; ``order`` should leave no ties. Decimal values are summed exactly.

    A key may hold any share of the rows: all rows are laid in one order and dealt to its ranges, each of which also gets the
    ``preceding`` rows before it, so that every frame lies in one range.
    """
    valued = df.withColumn("_value", value if isinstance(value, Column) else F.col(value))
    summed = ranges.rolling(valued, key, order, preceding, {"_sum": F.sum("_value"), "_n": F.count("_value")})
    return summed.withColumn("rolling_mean", F.col("_sum").cast("double") / F.col("_n")).select(*df.columns, "rolling_mean")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def minute_buckets(df: DataFrame, key: str, time: str) -> DataFrame:
    return df.groupBy(key, F.window(F.col(time).cast("timestamp"), "1 minute").start.cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("calls"))


def transfer_ledger(df: DataFrame) -> DataFrame:
    """day, account, up, down, up_left from (time, direction, account, bytes)."""
    daily = df.groupBy(F.to_date("time").alias("day"), "account").pivot("direction", ["up", "down"]).agg(F.sum("bytes"))
    return daily.select("day", "account", F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down"), (F.lit(UP_BYTES) - F.coalesce("up", F.lit(0))).alias("up_left"))


def quota_usage(calls: DataFrame, rate: int, daily: int) -> DataFrame:
    """user_id, day, accepted, denied of calls (user_id, time, call_id).

    A call is denied when its minute already has ``rate`` accepted ones, or its day ``daily``; a denied call
    uses nothing. Within a minute the first calls are accepted, up to what rate and day leave, so that
    counts by minute decide: each minute's allowance is the lesser of its calls and the rate, and the
    day's total of allowances is cut at the quota. No order of single calls is replayed.
    """
    minutes = calls.groupBy("user_id", F.to_date("time").alias("day"), F.date_trunc("minute", "time").alias("minute")).agg(F.count(F.lit(1)).alias("calls"))
    days = minutes.groupBy("user_id", "day").agg(F.sum("calls").alias("calls"), F.sum(F.least("calls", F.lit(rate))).alias("allowed"))
    return days.select("user_id", "day", F.least("allowed", F.lit(daily)).alias("accepted"), (F.col("calls") - F.least("allowed", F.lit(daily))).alias("denied"))


def state_counts(df: DataFrame, states: list[str]) -> DataFrame:
    """One row: how many there are of each state, absent ones 0."""
    return df.agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])


def latency(df: DataFrame, last: int = 200) -> DataFrame:
    """Mean over the newest ``last`` requests (time, call_id, ms), and how many there are in all."""
    newest = df.orderBy(F.desc("time"), F.desc("call_id")).limit(last)
    rows = newest.select("ms", F.lit(0).cast("long").alias("n")).unionByName(df.agg(F.lit(None).cast("double").alias("ms"), F.count(F.lit(1)).alias("n")))
    return rows.agg(F.round(F.avg("ms"), 6).alias("mean_ms"), F.sum("n").alias("requests"))


def slow_calls(df: DataFrame, over_ms: float) -> DataFrame:
    return df.where(F.col("ms") > over_ms)


def throughput(rows: Column, size: Column, seconds: Column) -> tuple[Column, Column]:
    """rows_per_s and mb_per_s."""
    spent = F.greatest(seconds, F.lit(1e-9))
    return (rows / spent).alias("rows_per_s"), (size / 1e6 / spent).alias("mb_per_s")


def newest(df: DataFrame, time: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n)


def audit_line(client: Column, action: Column, status: Column, ms: Column, detail: Column) -> Column:
    """A log line: detail cut at 300 characters, duration to one decimal, UTC time added by the writer."""
    return F.struct(client.alias("client"), action.alias("action"), status.alias("status"), F.round(ms, 1).alias("duration_ms"), F.substring(detail, 1, 300).alias("detail"))


