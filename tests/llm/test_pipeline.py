"""The pipeline against a plain version of its own, stage by stage, and the queries that have SQL."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tidelake.llm import decontaminate, secrets, toxicity
from tidelake.llm.queries import QUERIES, SQL

from ..conftest import SMALL
from .test_operators import contaminated, near_copies


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    score = model.scorer()
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i: t for i, t in rows.items() if score(t) < 0.3}
    a = stage["toxicity"](spark, docs, SMALL)
    assert a.columns == names and {r["doc_id"] for r in a.collect()} == set(clean)
    ids = sorted(clean)
    first = {ids[k] for k, g in enumerate(near_copies([clean[i] for i in ids])) if k == g}
    b = stage["near_duplicates"](spark, a, SMALL)
    assert b.columns == names and {r["doc_id"] for r in b.collect()} == first
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {i for i in first if not contaminated(clean[i], items)[4]}
    c = stage["decontamination"](spark, b, SMALL)
    assert c.columns == names and {r["doc_id"] for r in c.collect()} == kept
    d = stage["secrets"](spark, c, SMALL)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    assert d.columns == names and set(texts) == kept
    for i, t in texts.items():
        assert (t == clean[i]) == (not secrets.find_secrets(clean[i]))
    packed = stage["packing"](spark, d, SMALL).toPandas()
    assert set(packed.doc_id) == kept and packed.groupby("sequence_id").length.sum().max() <= 2048


ODD = [
    (1, None), (2, ""), (2, ""), (None, " \n\t "), (3, "one"), (3, "one"), (None, "one"), (None, None), (4, "É 中文 😀 " * 50), (5, "x" * 100_000),
    (6, "token = abcdefghijklmnop and more words here"), (7, "word " * 30_000), (8, "é"), (9, "a b c d"), (10, "A B C D"),
]
CLASHES = ["_hits", "_h", "hits", "digest", "fp", "node", "row", "judged", "contaminated", "cell", "rank", "start", "n", "number", "at", "c0", "first", "root", "spans"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    stage, columns = dict(corpus_pipeline.STAGES)[name], ["doc_id", "text", *CLASHES]
    docs = spark.createDataFrame([(i, t, *[k] * len(CLASHES)) for k, (i, t) in enumerate(ODD)], "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES))
    none = stage(spark, docs.limit(0), SMALL)
    assert none.count() == 0
    out = stage(spark, docs.repartition(3), SMALL)
    if name == "packing":
        assert out.where("piece = 0").count() == len(ODD) and none.columns == out.columns
        return
    assert out.columns == columns == none.columns
    kept = {r["digest"]: r["text"] for r in out.collect()}
    whole = {k: t for k, (_, t) in enumerate(ODD)}
    if name == "near_duplicates":
        order = sorted(whole, key=lambda k: (ODD[k][0] is None, ODD[k][0] or 0))
        groups = near_copies([ODD[k][1] for k in order])
        assert len(kept) == len(set(groups)) and all(whole[k] == t for k, t in kept.items())
        assert Counter((ODD[k][0], ODD[k][1] or "") for k in kept if (ODD[k][1] or "").split()) == Counter((ODD[order[g]][0], ODD[order[g]][1]) for g in set(groups) if (ODD[order[g]][1] or "").split())
    elif name == "secrets":
        assert kept.keys() == whole.keys() and "abcdefghijklmnop" not in kept[10] and all(whole[k] == t for k, t in kept.items() if k != 10)
    else:  # nothing here is toxic or from the benchmark
        assert kept == whole


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert decontaminate.words_of(None) == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as from '{SMALL}/{t}.parquet'")
    out = QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(SQL[name]).df()[list(out.columns)]
    order = list(out.columns)[:2]
    a, b = out.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True)
    assert len(a) == len(b)
    for c in a.columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
