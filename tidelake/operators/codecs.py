"""What a codec costs: size, and the time to write, to read one column and to read all."""

import time

from pyspark.sql import DataFrame, SparkSession

from ..scratch import file_system

CODECS = ("uncompressed", "snappy", "zstd")


def _seconds(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def measure(df: DataFrame, path: str, narrow: str, codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """codec, rows, bytes, write_s, narrow_s, full_s: ``df`` written under ``path`` with each codec and read again."""
    spark: SparkSession = df.sparkSession
    out = []
    for codec in codecs:
        at = f"{path}/{codec}"
        write_s = _seconds(lambda at=at, codec=codec: df.write.option("compression", codec).parquet(at))
        back = spark.read.schema(df.schema).parquet(at)
        sink = lambda x: x.write.format("noop").mode("overwrite").save()
        narrow_s, full_s = _seconds(lambda back=back: sink(back.select(narrow))), _seconds(lambda back=back: sink(back))
        fs, p = file_system(spark, at)
        out.append((codec, back.count(), fs.getContentSummary(p).getLength(), write_s, narrow_s, full_s))
    return spark.createDataFrame(out, "codec string, rows long, bytes long, write_s double, narrow_s double, full_s double")
