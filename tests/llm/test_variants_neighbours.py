"""Spelling variants and nearest neighbours against brute force."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidelake.llm import neighbours, variants
from tidelake.llm.shared import Scratch


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(rows):
    """The contract, word for word."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w] or "", n[form[w]] if form[w] else -1, root(w)) for w in n)


def got_variants(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"] or "", -1 if r["form_n"] is None else r["form_n"], r["root"]) for r in df.collect())


def corpus():
    r = np.random.default_rng(5)
    letters = list("abcdéÀß×")
    words = ["".join(r.choice(letters[:3], int(r.integers(4, 8)))) for _ in range(300)]
    words += ["LANTERN", "lantern", "lanterns", "lantrn", "Éclair", "éclair", "eclair", "aaaaa", "aaaaaa", "aaaaaaa", "ananas", "nananas", "x" * 400, "x" * 401, "x" * 399 + "y"]
    rows = [(int(i), " ".join(r.choice(words, 60)) + ", " + " ".join(words[-15:]) * int(r.integers(1, 3))) for i in range(60)]
    return [*rows, (None, "lantern lantern"), (None, None), (7, ""), (7, "12 -- 3"), rows[0], rows[0], (10**12, "x" * 100_000)]


def test_variants(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert got_variants(variants.variants(docs)) == plain_variants(rows)
    assert variants.variants(docs.limit(0)).collect() == []


@pytest.mark.parametrize("crowd", [2, 9, 8192])
def test_near_pairs_of_split_states(spark, crowd):
    """However small the partitions are made, each pair comes once."""
    words = sorted({r for r in re.findall(r"\w+", " ".join(t or "" for _, t in corpus())) if 5 <= len(r) < 500})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = [tuple(sorted(r)) for r in variants.links(df, Scratch(spark), crowd).collect()]
    assert sorted(got) == sorted(tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p))


def test_composition_is_minimal():
    words = sorted(["tests", "texts", "rests", "taxes"])
    machine = variants.Composition(words)
    assert machine.language(machine.root) == words
    # r and t lead to states of which those behind "es" and "ex" are one with others of the same language
    assert len({str(sorted(machine.language(k))) for k in range(len(machine.arcs))}) == len(machine.arcs)


def test_variants_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()][:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_variants(variants.variants(docs)) == plain_variants(rows)
    assert variants.op11_variants(spark, sf_dir).count() > 1000


def plain_nearest(rows, every, k):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, np.float64)).all() and any(v)]
    out = []
    for q, (i, a) in enumerate(rows):
        if i % every == 0:
            near = sorted((-float(neighbours.cosines(a[None], b[None])[0]), j) for c, (j, b) in enumerate(rows) if c != q and len(a) == len(b))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near[:k], 1)]
    return sorted(out)


def vectors():
    r = np.random.default_rng(3)
    flat = r.normal(size=(120, 6)).astype(np.float32).tolist()
    rows = [(n, v) for n, v in enumerate(flat)]
    rows += [(200 + n, flat[0]) for n in range(40)] + [(300 + n, [2 * x for x in flat[1]]) for n in range(12)]  # a hot vector; the same direction
    rows += [(0, flat[0]), (10, flat[11]), (400, None), (410, []), (420, [0.0] * 6), (430, [float("nan"), *flat[2][1:]]), (440, [None, *flat[2][1:]]), (450, [float("inf"), *flat[2][1:]]), (None, flat[3])]
    rows += [(500, [1.0, 2.0]), (510, [2.0, 1.0]), (520, [-0.0, 1.0]), (530, [0.0, 1.0]), (600, [1.0])]
    return rows


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, label int, row int, score double").repartition(3)
    got = sorted(map(tuple, neighbours.nearest(df, every=10, k=5, block=block).collect()))
    assert got == plain_nearest(rows, 10, 5)
    assert neighbours.nearest(df.limit(0)).collect() == []
    wide = np.random.default_rng(1).normal(size=(30, 1500))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, neighbours.nearest(df, every=10).collect())) == plain_nearest([(i, v.tolist()) for i, v in enumerate(wide)], 10, 5)


def test_bounds_hold():
    r = np.random.default_rng(2)
    u, v = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in (r.normal(size=(50, 33)) ** 3, r.normal(size=(70, 33))))
    (a, ab), (b, bb) = neighbours.quantise(u), neighbours.quantise(v)
    near = neighbours.products(a, b) * ab[:, :1] * bb[:, 0]
    error = ab[:, 1:2] * bb[:, 2] + ab[:, 2:]
    assert (abs(u @ v.T - near) <= error + 1e-12).all() and error.max() < 0.2
    assert np.array_equal(neighbours.products(a, b), (a.astype(int) @ b.astype(int).T))


def test_op13_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, neighbours.op13_neighbours(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect())) == sorted(con.sql(neighbours.OP13_SQL).fetchall())
