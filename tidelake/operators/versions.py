"""Publishing without a gap: versions of a dataset in folders of their own, and a pointer that is switched by creating one small file.

<path>/_v-<unique>/      a version's files; the underscore hides it from plain readers, who would see several versions at once
<path>/_current/<n>      a small file that names version n's folder; the greatest n counts

A version is written and counted before its pointer is created, which is the one step that readers notice. A pointer that is empty
still (its writer was lost, or is at it) does not count. The version before the current one stays for those who are reading it.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..scratch import children, delete, get_text, put_text

KEPT = 2


def pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(n, folder) of all versions that a pointer names, newest first."""
    numbers = sorted((int(n) for n in children(spark, f"{path}/_current") if n.isdigit()), reverse=True)
    told = [(n, get_text(spark, f"{path}/_current/{n}").strip()) for n in numbers]
    return [(n, folder) for n, folder in told if folder]


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that counts now."""
    found = pointers(spark, path)
    if not found:
        raise FileNotFoundError(f"nothing is published at {path}")
    return f"{path}/{found[0][1]}"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))


def stage(df: DataFrame, path: str, least_rows: int = 1) -> tuple[str, int]:
    """Write a version that no pointer names yet: its folder and rows. One with fewer than ``least_rows`` is refused."""
    folder = f"_v-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{path}/{folder}")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{folder}").count()
    if rows < least_rows:
        delete(df.sparkSession, f"{path}/{folder}")
        raise ValueError(f"{rows} rows for {path}; not published")
    return folder, rows


def switch(spark: SparkSession, path: str, folder: str) -> int:
    """Make a staged version the current one: its number. Of two writers at once both get a number, and the later one counts."""
    number = 1 + max((int(n) for n in children(spark, f"{path}/_current") if n.isdigit()), default=0)
    while not put_text(spark, f"{path}/_current/{number}", folder):
        number += 1
    return number


def tidy(spark: SparkSession, path: str, kept: int = KEPT) -> int:
    """Delete all but the newest ``kept`` versions that pointers name, folders first: how many."""
    old = pointers(spark, path)[kept:]
    for n, folder in old:
        delete(spark, f"{path}/{folder}")
        delete(spark, f"{path}/_current/{n}")
    return len(old)


def publish(df: DataFrame, path: str, least_rows: int = 1) -> dict:
    """Stage, switch, tidy up. Returns version and rows."""
    path = path.rstrip("/")
    folder, rows = stage(df, path, least_rows)
    number = switch(df.sparkSession, path, folder)
    tidy(df.sparkSession, path)
    return {"version": number, "rows": rows}
