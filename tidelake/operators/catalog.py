"""The catalog of datasets: a log of writes, and views of it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEPS = ["layer", "path", "partition_keys"]


def merge(shards: DataFrame) -> DataFrame:
    """One row a dataset: totals, widest span, descriptions of the newest entry, the account of the oldest.

    Nulls and empty strings do not describe. The log of writes is only ever appended to; this is how it is read.
    """
    said = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    newest = lambda c: F.max_by(said(c), F.when(said(c).isNotNull(), F.col("updated_at"))).alias(c)
    return shards.groupBy("dataset").agg(
        *[newest(c) for c in KEEPS if c in shards.columns], F.min_by(said("account"), F.when(said("account").isNotNull(), F.col("updated_at"))).alias("account"),
        F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.min("time_min").alias("time_min"), F.max("time_max").alias("time_max"), F.max("updated_at").alias("updated_at"),
    )


def record_write(entry: DataFrame, log: str) -> None:
    """Add a write to the log. Totals add up and spans widen when the log is read with merge()."""
    entry.write.mode("append").parquet(log)


def summary(catalog: DataFrame) -> DataFrame:
    """datasets, rows, bytes, files by layer, and of all (layer null)."""
    return catalog.rollup("layer").agg(F.count(F.lit(1)).alias("datasets"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))


def placement(accounts: DataFrame, catalog: DataFrame) -> DataFrame:
    """datasets and bytes of each account, with or without any."""
    return accounts.join(catalog.select("account", "dataset", "bytes"), "account", "left").groupBy("account").agg(F.count("dataset").alias("datasets"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def unplaced(accounts: DataFrame, catalog: DataFrame) -> DataFrame:
    return catalog.join(accounts, "account", "left_anti")


def measured(layout: DataFrame, sizes: DataFrame) -> DataFrame:
    """chain, table, gb of every table of the layout, largest first; unmeasured ones null and last."""
    return layout.join(sizes, ["chain", "table"], "left").orderBy(F.coalesce("gb", F.lit(0.0)).desc(), "chain", "table")


def size_totals(layout: DataFrame, sizes: DataFrame) -> DataFrame:
    """Gigabytes by chain and in all (chain null), to one decimal."""
    return layout.join(sizes, ["chain", "table"], "left").rollup("chain").agg(F.round(F.sum("gb"), 1).alias("gb"))
