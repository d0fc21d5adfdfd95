"""Ledger extracts and generated rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = {
    "blocks": ["number", "hash", "timestamp"],
    "transactions": ["hash", "block_number", "from", "to", "value", "gas_used"],
    "logs": ["address", "topic0"],
}


def read(spark: SparkSession, root: str, chain: str, entity: str) -> DataFrame:
    """One entity's files of a chain, its own columns only; synthetic rows are left out."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{entity}*.parquet").parquet(f"{root}/symbol={chain.upper()}")
    real = df.where(~F.coalesce(F.col("is_synthetic"), F.lit(False))) if "is_synthetic" in df.columns else df
    return real.select(*[f"`{c}`" for c in ENTITIES[entity]])


def block_range(df: DataFrame, first: int, last: int, column: str = "block_number") -> DataFrame:
    return df.where(F.col(f"`{column}`").between(first, last))


def synthetic(spark: SparkSession, first: int, last: int, rows: int = 1000, seed: int = 7) -> DataFrame:
    """Rows that look like a ledger's; every one is marked is_synthetic."""
    span = max(1, last - first + 1)
    hexed = lambda name, digits: F.concat(F.lit("0x"), F.substring(F.sha2(F.concat(F.lit(name), F.col("id").cast("string")), 256), 1, digits))
    return spark.range(rows).select(
        (F.lit(first) + F.col("id") % span).alias("block_number"), hexed("block", 64).alias("block_hash"), (F.lit(1_700_000_000) + F.col("id") * 12).alias("timestamp"),
        hexed("tx", 64).alias("tx_hash"), hexed("from", 40).alias("from_addr"), hexed("to", 40).alias("to_addr"), F.round(F.rand(seed) * 10, 6).alias("value"),
        (F.lit(21_000) + F.floor(F.rand(seed + 1) * 100_000)).cast("long").alias("gas_used"), F.lit(True).alias("is_synthetic"),
    )


def bench_rows(spark: SparkSession, rows: int = 50_000_000, seed: int = 11) -> DataFrame:
    """block_time, from_address, to_address, value, token, made on the executors."""
    return spark.range(rows).select(
        (F.lit(1_600_000_000) + F.col("id")).alias("block_time"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2_000_000)).alias("from_address"),
        F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(2_000_000)).alias("to_address"), F.rand(seed).alias("value"), F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(5_000)).cast("int").alias("token"),
    )
