"""Near copies in crowds, where most texts are alike to some others but not to the first of their key."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import packing, sharding, simhash


def copies(n, edits, seed):
    r = np.random.default_rng(seed)
    base = [f"w{x}" for x in r.integers(0, 5000, 300)]
    texts = []
    for _ in range(n):
        words = list(base)
        for k in r.choice(300, int(r.integers(*edits)), replace=False):
            words[k] = f"z{r.integers(0, 10**6)}"
        texts.append(" ".join(words))
    return texts


def kept_by_brute_force(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return sorted({root(i) for i in range(len(texts))})


@pytest.mark.parametrize("n, edits, seed", [(200, (4, 5), 1), (40, (4, 5), 2), (100, (3, 6), 3)])
def test_keep_one_in_crowds(spark, n, edits, seed):
    texts = copies(n, edits, seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()) == kept_by_brute_force(texts)


def test_links_within_a_block():
    """As many components as by all pairs, whatever is connected before."""
    texts = copies(60, (3, 7), 5)
    sets = [np.unique([hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)]) for w in map(str.split, texts)]
    kept = kept_by_brute_force(texts)
    up = list(range(60))
    for a, b in simhash.alike_in_block(sets, list(range(60)), 0.8, columns=50):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        assert a != b
        up[max(a, b)] = min(a, b)
    assert [k for k in range(60) if up[k] == k] == kept
    assert simhash.alike_in_block(sets, [7] * 60, 0.8) == []


def test_crowd_larger_than_blocks(spark):
    """A group of which a tenth of all pairs are alike, several blocks large: all but a few texts are connected."""
    texts = copies(700, (3, 5), 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept, want = simhash.keep_one(docs).count(), len(kept_by_brute_force(texts))
    assert want <= kept <= want + 7


def test_nothing_of_a_large_key_is_missed(spark, monkeypatch):
    """Texts of one key, far more than a block, whose only alike ones meet in few blocks: all are connected as by brute force."""
    pairs = [f"{' '.join(f'p{k}-{i}' for i in range(40))} {end}" for k in range(60) for end in ("left", "right")]
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "band_keys", lambda distinct: np.array([7], np.uint64))  # all share it
    docs = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()) == list(range(0, 120, 2)) == kept_by_brute_force(pairs)


def test_equal_rows_are_numbered_in_many_cells(spark, monkeypatch):
    """Repeated and null ids: a row number tells equal rows apart, and no cell has most of them."""
    from tidelake.llm import shared

    shares = []
    numbered = shared.numbered

    def watched(df, keys, order, out, rows_per_cell=100_000):
        spread = df.groupBy(*keys, F.pmod(F.xxhash64(*order), F.lit(64)).alias("_c")).count().agg(F.max("count"), F.sum("count")).first()
        if spread[1] > 100:
            shares.append(spread[0] / spread[1])
        return numbered(df, keys, order, out, rows_per_cell)

    for module in (packing, sharding):
        monkeypatch.setattr(module, "numbered", watched)
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    slots = sharding.into_shards(docs, 4)
    packed = packing.pack_documents(docs, packing.word_bpe_path())
    assert packed.groupBy("sequence_id").agg(F.count_distinct("offset").alias("d"), F.count(F.lit(1)).alias("n")).where("d <> n").count() == 0
    assert "_piece_row" not in packed.columns and len(shares) == 2 and max(shares) < 0.1
    assert slots.select("shard", "slot").distinct().count() == 4000
