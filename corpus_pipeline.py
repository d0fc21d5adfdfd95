"""The training-data pipeline: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Between stages the
documents are written as Parquet and read again, so that a lost executor costs one stage at most.

All stages: null ids stay and are equal to each other; rows are judged each by itself, so that repeated rows share a fate, except
in near_duplicates, which keeps one; no rows give no rows; other columns come back unchanged under whatever names (packing
does not return them).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import decontaminate, packing, secrets, simhash, toxicity
from tidelake.llm.shared import Scratch, fresh


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; null and empty texts score 0 and stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(model, spark)(F.col("text")) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies: word shingles of five, likeness 0.8 or more.

    Texts without words, null and empty ones, are one group.
    """
    return simhash.keep_one(docs, least=0.8, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows; null and empty texts stay."""
    hits = fresh("_hits", docs.columns)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=hits)
    return found.where(~F.col(f"{hits}.contaminated")).drop(hits)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their text replaced by their kind; null texts stay null, empty ones empty."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens; null and empty texts are the end id alone."""
    return packing.pack_documents(docs, packing.word_bpe_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL has neither the tokenizer nor the learned scores; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
