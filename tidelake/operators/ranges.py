"""Scans in one order over all rows, without a task that has a whole key.

Rows are dealt to ranges of the order and written once. What a row needs of those before it comes from its own range and from a
table of one row a range: the rows at a range's border, or the last value of a range, carried over to the next.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

RANGE = "_range"


def in_ranges(df: DataFrame, order: list, tasks: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``order``, with the number of each row's range; ranges follow one another in that order."""
    dealt = df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)
    return written(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges")


def reaches(sizes: list[tuple[int, int]], rows: int) -> list[tuple[int, int, int]]:
    """(range, later range, how many of its last rows the later one needs), if each row needs the ``rows`` before it. sizes: range, rows."""
    found, ordered = [], sorted(sizes)
    for k, (own, _) in enumerate(ordered):
        between = 0
        for later, n in ordered[k + 1 :]:
            if between >= rows:
                break
            found.append((own, later, rows - between))
            between += n
    return found


def with_borders(dealt: DataFrame, order: list[str], rows: int) -> DataFrame:
    """The rows of every range and, marked as ``_guest``, the ``rows`` rows before it. Only the last rows of ranges are exchanged."""
    spark = dealt.sparkSession
    sizes = [(r[0], r[1]) for r in dealt.groupBy(RANGE).agg(F.count(F.lit(1))).collect()]  # one row a range
    pairs = spark.createDataFrame(reaches(sizes, rows), f"{RANGE} int, _to int, _most int")
    last = F.row_number().over(Window.partitionBy(RANGE).orderBy(*[F.desc(c) for c in order]))
    borders = dealt.withColumn("_last", last).where(F.col("_last") <= rows).join(F.broadcast(pairs), RANGE).where("_last <= _most")
    guests = borders.drop(RANGE, "_last", "_most").withColumnRenamed("_to", RANGE).withColumn("_guest", F.lit(True))
    return dealt.withColumn("_guest", F.lit(False)).unionByName(guests)


def carried(dealt: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``value``, where it is null, from the last row before that has one and the same ``key`` (never null ones of another key).

    Within a range by a window; at its beginning from the ranges before: of each its first and last key, and
    the last value of the last key, are one row.
    """
    own = Window.partitionBy(RANGE, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumn("_own", F.last(value, ignorenulls=True).over(own))
    at = F.struct(key, *order)
    ends = dealt.groupBy(RANGE).agg(F.min_by(F.struct(key), at).alias("first"), F.max_by(F.struct(key), at).alias("last"))
    last_value = dealt.where(F.col(value).isNotNull()).groupBy(RANGE).agg(F.max_by(F.struct(F.col(key).alias("key"), F.col(value).alias("value")), at).alias("held"))
    summary = ends.join(last_value, RANGE, "left")
    # a range hands on what it holds of its last key; one that lies within a single key hands on what it was given
    holds = F.col("held").isNotNull() & F.col("held.key").eqNullSafe(F.col(f"last.{key}"))
    through = F.col(f"first.{key}").eqNullSafe(F.col(f"last.{key}"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    kind = dealt.schema[value].dataType

    def says(content: Column):
        return F.struct(F.col(f"last.{key}").alias("key"), content.cast(kind).alias("value"))

    said = F.when(holds, says(F.col("held.value"))).when(~through, says(F.lit(None)))
    given = summary.withColumn("_said", F.last(said, ignorenulls=True).over(before)).select(RANGE, "_said")
    joined = filled.join(F.broadcast(given), RANGE, "left")
    fits = F.col("_said.key").eqNullSafe(F.col(key)) & F.col("_said").isNotNull()
    return joined.withColumn(value, F.coalesce("_own", F.when(fits, F.col("_said.value")))).select(*dealt.columns)


def rolling(df: DataFrame, key: str, order: list[str], preceding: int, made: dict[str, Column]) -> DataFrame:
    """Columns ``made`` as aggregates over each row and the ``preceding`` before it of the same key."""
    every = with_borders(in_ranges(df, [key, *order]), [key, *order], preceding)
    w = Window.partitionBy(RANGE, key).orderBy(*order).rowsBetween(-preceding, 0)
    return every.withColumns({name: c.over(w) for name, c in made.items()}).where("not _guest").drop("_guest", RANGE)
