"""A request frontier as table transforms: add, reserve, complete, fail, reclaim."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digest_key, owner_slice

MAX_ATTEMPTS = 3


def key_of(method: Column, url: Column, payload: Column) -> Column:
    return digest_key(F.concat_ws(" ", F.upper(method), url, F.coalesce(payload, F.lit(""))), 32)


def add(frontier: DataFrame | None, candidates: DataFrame, workers: int = 1, worker: int | None = None) -> DataFrame:
    """New pending rows of candidates (url, method, payload, added_at): once each, not known yet, and owned by ``worker`` if one is given."""
    rows = candidates.withColumn("key", key_of(F.col("method"), F.col("url"), F.col("payload"))).groupBy("key").agg(
        F.min_by("url", "added_at").alias("url"), F.min_by("method", "added_at").alias("method"), F.min_by("payload", "added_at").alias("payload"), F.min("added_at").alias("added_at")
    )
    rows = rows.withColumns({"state": F.lit("pending"), "attempts": F.lit(0), "worker": owner_slice(F.col("key"), workers)})
    if worker is not None:
        rows = rows.where(F.col("worker") == worker)
    return rows if frontier is None else rows.join(frontier.select("key"), "key", "left_anti")


def reserve(frontier: DataFrame, each: int, now: float, cells: int = 64) -> DataFrame:
    """The frontier with the oldest ``each`` pending rows of every worker running.

    Each of a worker's ``cells`` by key offers its oldest ones, so that no task gets a worker's whole frontier: the last
    choice is among ``cells`` * ``each`` rows a worker. Only the keys of the chosen are joined back.
    """
    oldest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("added_at", "key"))
    waiting = frontier.where(F.col("state") == "pending").select("worker", "added_at", "key", F.pmod(F.xxhash64("key"), F.lit(cells)).alias("_cell"))
    offered = waiting.withColumn("_turn", oldest("worker", "_cell")).where(F.col("_turn") <= each)
    chosen = offered.withColumn("_turn", oldest("worker")).where(F.col("_turn") <= each).select("key", F.lit(True).alias("_taken"))
    taken = F.coalesce("_taken", F.lit(False))
    kept = [c for c in frontier.columns if c not in ("state", "attempts", "reserved_at")]
    return frontier.join(chosen, "key", "left").select(
        *kept, F.when(taken, "running").otherwise(F.col("state")).alias("state"),
        (F.col("attempts") + taken.cast("int")).alias("attempts"), F.when(taken, F.lit(now)).alias("reserved_at"),
    )


def finish(frontier: DataFrame, results: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Apply results (key, ok, error): done, or pending again while attempts are left, else failed. Unknown keys are an error."""
    unknown = results.join(frontier, "key", "left_anti").limit(1).count()
    if unknown:
        raise KeyError("results name keys that the frontier does not have")
    joined = frontier.join(results.select("key", "ok", F.substring("error", 1, 500).alias("error")), "key", "left")
    state = F.when(F.col("ok").isNull(), F.col("state")).when(F.col("ok"), "done").when(F.col("attempts") < max_attempts, "pending").otherwise("failed")
    return joined.withColumn("state", state).drop("ok")


def reclaim(frontier: DataFrame, older_than_s: float, now: float, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Rows running for longer than ``older_than_s`` are pending again, or failed where no attempt is left."""
    stale = (F.col("state") == "running") & (F.lit(now) - F.col("reserved_at") > older_than_s)
    return frontier.withColumn("state", F.when(stale & (F.col("attempts") < max_attempts), "pending").when(stale, "failed").otherwise(F.col("state")))
