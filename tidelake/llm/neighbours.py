"""Nearest neighbours by cosine: a block matrix join with int8 tiles, exact by error bounds.

Each vector is scaled to length 1 and rounded to int8: u = s q + e. For two of them

    |u . v - s_u s_v (q_u . q_v)|  <=  |s_u q_u| |e_v| + |e_u|,

so that one product of two int8 blocks (integers, exact in float32 pieces) bounds the cosine of all their pairs from both sides.
Pairs whose upper bound lies below a query's fifth best lower bound, or its fifth best score so far, are given up; the cosines of those
that survive are computed from the original vectors in double precision, and heaps of the best are merged: over the blocks of a strip in
its task, then over strips on Spark. Nothing is approximate in the result.

Equal vectors are one class with its least ids, on both sides, so that a vector with a third of all rows costs as much as any other.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, crowd_join

BLOCK, QUERIES = 4_096, 512
STRIPS, STRIP_BLOCKS = 64, 16
#: Products of int8 below 2 ** 24 are exact in float32: so many at most are added before they go to float64.
EXACT = 1_024
#: What rounding in float64 can add to a bound.
SLACK = 1e-9
BLOCKS = "dim int, block long, rows int, classes binary, ids binary, vectors binary, quantised binary, bounds binary"


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 rows, and for each (scale, length of scale * row, length of what rounding has left)."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    length = lambda m: np.sqrt((m * m).sum(axis=1))
    return q, np.stack([scale, length(back), length(unit - back)], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of all rows of two int8 blocks."""
    total = 0.0
    for k in range(0, a.shape[1], EXACT):
        part = a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
        total = total + part.astype(np.float64)
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows, in double precision; components are added in their order, so that equal pairs get equal values."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        x, y = a[:, k], b[:, k]
        dot += x * y
        aa += x * x
        bb += y * y
    return np.clip(dot / (np.sqrt(aa) * np.sqrt(bb)), -1.0, 1.0)


def _blocks(size: int):
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of up to ``size`` vectors of one dimension, numbered within the task."""
        waiting: dict[int, list] = {}
        number = 0

        def block(dim: int, rows: list) -> pd.DataFrame:
            nonlocal number
            number += 1
            vectors = np.array([v for _, _, v in rows], np.float64)
            largest = np.abs(vectors).max(axis=1, keepdims=True)
            unit = vectors / largest
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            q, bounds = quantise(unit)
            classes, ids = (np.array([r[k] for r in rows], np.int64).tobytes() for k in (0, 1))
            return pd.DataFrame([(dim, number, len(rows), classes, ids, vectors.tobytes(), q.tobytes(), bounds.tobytes())], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for row in zip(batch["class"].tolist(), batch["least_id"].tolist(), batch["vector"].tolist(), strict=True):
                held = waiting.setdefault(len(row[2]), [])
                held.append(row)
                if len(held) >= size:
                    yield block(len(row[2]), held)
                    waiting[len(row[2])] = []
        for dim, held in waiting.items():
            if held:
                yield block(dim, held)

    return blocks


class _Block:
    def __init__(self, dim: int, classes: bytes, ids: bytes, vectors: bytes, quantised: bytes, bounds: bytes):
        self.classes, self.ids = (np.frombuffer(x, np.int64) for x in (classes, ids))
        self.vectors = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.q = np.frombuffer(quantised, np.int8).reshape(-1, dim)
        self.scale, self.length, self.rest = np.frombuffer(bounds, np.float64).reshape(-1, 3).T


class Best:
    """For each query of a block the ``k`` nearest classes seen so far: score, class and its least id."""

    def __init__(self, queries: _Block, k: int):
        n = len(queries.classes)
        self.queries, self.k = queries, k
        self.scores = np.full((n, k), -np.inf)
        self.ids, self.classes = (np.full((n, k), np.iinfo(np.int64).max) for _ in range(2))

    def meet(self, others: _Block) -> None:
        a, b = self.queries, others
        near = products(a.q, b.q) * a.scale[:, None] * b.scale[None, :]
        error = a.length[:, None] * b.rest[None, :] + a.rest[:, None] + SLACK
        least = self.scores[:, -1]
        if near.shape[1] >= self.k:
            least = np.maximum(least, np.partition(near - error, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(near + error >= least[:, None])
        if not len(i):
            return
        scores = np.empty(len(i))
        for at in range(0, len(i), 50_000):
            part = slice(at, at + 50_000)
            scores[part] = cosines(a.vectors[i[part]], b.vectors[j[part]])
        better = scores >= self.scores[i, -1]
        i, j, scores = i[better], j[better], scores[better]
        touched = np.unique(i)
        rows = np.concatenate([i, np.repeat(touched, self.k)])
        scores = np.concatenate([scores, self.scores[touched].ravel()])
        ids = np.concatenate([b.ids[j], self.ids[touched].ravel()])
        classes = np.concatenate([b.classes[j], self.classes[touched].ravel()])
        order = np.lexsort((classes, ids, -scores, rows))
        rows = rows[order]
        first = np.searchsorted(rows, touched)
        place = np.arange(len(rows)) - np.repeat(first, np.diff([*first, len(rows)]))
        kept = place < self.k
        for own, new in ((self.scores, scores), (self.ids, ids), (self.classes, classes)):
            own[touched] = new[order][kept].reshape(-1, self.k)

    def rows(self) -> pd.DataFrame:
        found = np.isfinite(self.scores)
        query = np.repeat(self.queries.classes, self.k).reshape(found.shape)
        return pd.DataFrame({"query": query[found], "other": self.classes[found], "least_id": self.ids[found], "score": self.scores[found]})


def _tiles(k: int):
    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of blocks; those of one query block and strip follow one another and share a heap a query."""
        now, best = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if now != (r.strip, r.q_block):
                    if best:
                        yield best.rows()
                    now, best = (r.strip, r.q_block), Best(_Block(r.dim, r.q_classes, r.q_ids, r.q_vectors, r.q_quantised, r.q_bounds), k)
                best.meet(_Block(r.dim, r.classes, r.ids, r.vectors, r.quantised, r.bounds))
        if best:
            yield best.rows()

    return tiles


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The ``k`` rows nearest to each row whose vec_id ``every`` divides: query_id, rank (from 1), vec_id, score.

    vectors: vec_id, embedding. Nearest is the largest cosine in double precision, ties to the smaller vec_id; a row is no candidate of its
    own, but repeated rows are of each other, and each is a query with rows of its own. Fewer candidates than ``k`` are all returned. Vectors that are
    null, empty, zero, or hold null or non-finite components take no part, nor do rows of a null vec_id or vectors whose squares
    leave the range of doubles; vectors of different dimensions do not meet. Other columns are not looked at; no rows give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    vector = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 and 0.0 are one
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    sound = F.col("vec_id").isNotNull() & ~F.exists("vector", odd) & (squares > 0) & (squares < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(sound)
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    # a class has the rows of one vector: its least row number names it; of k + 1 rows one may be the query's own
    same = Window.partitionBy("vector").orderBy("vec_id", "row")
    members = rows.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1)
    classes = members.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
    classes = classes.select("vector", "members", F.col("members")[0]["row"].alias("class"), F.col("members")[0]["vec_id"].alias("least_id"))
    classes = scratch.save(classes, "classes")
    asking = rows.where(F.col("vec_id") % every == 0)
    asked = asking.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"))
    asked = scratch.save(asked.join(classes, "vector").select("vector", "class", "least_id", "copies"), "asked")
    columns = [c.split()[0] for c in BLOCKS.split(", ")]
    key = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("block")

    def blocked(df: DataFrame, size: int, name: str) -> DataFrame:
        made = df.select("class", "least_id", "vector").mapInPandas(_blocks(size), BLOCKS)
        return scratch.save(made.withColumn("block", key), name)

    others, queries = blocked(classes, block, "blocks"), blocked(asked, QUERIES, "queries")
    n = others.count()
    strips = max(1, min(n, STRIPS), -(-n // STRIP_BLOCKS))
    strip = F.pmod(F.xxhash64("block"), F.lit(strips)).cast("int").alias("strip")
    dealt = queries.select("dim", *[F.col(c).alias(f"q_{c}") for c in columns if c != "dim"], F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"))
    tiles = dealt.hint("merge").join(others.select("*", strip), ["strip", "dim"]).drop("q_rows", "rows", "block")
    best = scratch.save(tiles.mapInPandas(_tiles(k + 1), "query long, other long, least_id long, score double"), "best")
    turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least_id", "other"))
    top = best.withColumn("_r", turn).where(F.col("_r") <= k + 1)
    # the k + 1 nearest classes hold the k nearest rows; ids and numbers of at most (k + 1) ** 2 rows a query class
    found = top.join(classes.select(F.col("class").alias("other"), "members"), "other")
    found = found.groupBy("query").agg(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct((-F.col("score")).alias("less"), m["vec_id"].alias("vec_id"), m["row"].alias("row"))))).alias("found"))
    facts = scratch.save(found.join(asked.select(F.col("class").alias("query"), "vector", "copies"), "query").select("vector", "copies", F.array_sort("found").alias("found")), "found")
    met = crowd_join(asking, facts, "vector", "copies", asking.count())
    others_of = F.slice(F.filter("found", lambda x: x["row"] != F.col("row")), 1, k)
    ranked = met.select(F.col("vec_id").alias("query_id"), F.posexplode(others_of).alias("_p", "_o"))
    return ranked.select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_o.vec_id").alias("vec_id"), (-F.col("_o.less")).alias("score"))


def op13_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows of each row whose vec_id 50 divides, among all embeddings."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
with v as (select vec_id, embedding::double[] as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id,
        list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) as score
      from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 5"""
