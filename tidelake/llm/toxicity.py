"""Toxicity by multiple-instance learning.

A document's label does not say which sentence is toxic. Each sentence gets a score of its own, a
logistic function of its words and word beginnings, and a document is toxic unless all its sentences are clean:
the sentence scores are combined by noisy-or, P = 1 - prod(1 - p). The weights are learned from the
document labels through that combination; the sentence scores then tell where the offence is.
"""

import functools
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import small_batches

SENTENCE_END = re.compile(r"[.?\n]+|(?<!!)!(?!!)")  # a run of exclamation marks is no end: shouted words are no sentences
EDGES = "\"'()[]{}<>|,;:*#_-+=/\\&%$"
THRESHOLD = 0.3
#: Bounds of the training sample: labelled documents of each class, and characters of each.
SAMPLE_DOCS, SAMPLE_CHARS, FEATURES = 3_000, 12_000, 5_000


def features_of(token: str) -> list[str]:
    """A lower-case token's word and its beginnings of four, five and six letters."""
    word = token.strip(EDGES)
    return [f"={word}", *(word[:k] for k in (4, 5, 6) if len(word) >= k)] if word else []


def softplus(z):
    return np.logaddexp(0.0, z)


class Model:
    """Weights of features, a bias for each sentence, and the share of P that counts as the threshold."""

    def __init__(self, weights: dict[str, float], bias: float, cut: float = THRESHOLD):
        self.weights, self.bias, self.cut = weights, bias, cut

    def scorer(self, keep: int = 150_000):
        """A function from a text to its score; it remembers the weights of up to ``keep`` tokens."""
        weights, bias = self.weights, self.bias

        class Known(dict):
            def __missing__(self, token):
                if len(self) >= keep:
                    self.clear()
                w = self[token] = sum(weights.get(f, 0.0) for f in features_of(token))
                return w

        known = Known()

        def sums(text: str) -> np.ndarray:
            return np.array([sum(map(known.__getitem__, s)) for s in (set(x.split()) for x in SENTENCE_END.split(text.lower())) if s], float)

        def score(text: str | None) -> float:
            z = sums(text) if isinstance(text, str) else np.empty(0)
            return self.graded(-np.expm1(-softplus(z + bias).sum()))

        return score

    def graded(self, p):
        """P moved so that the learned cut stands at the threshold; order is kept."""
        return np.where(p < self.cut, THRESHOLD * p / self.cut, THRESHOLD + (1 - THRESHOLD) * (p - self.cut) / max(1e-9, 1 - self.cut))

    def offending(self, text: str) -> list[tuple[int, int, float]]:
        """The sentences to blame for a text that scores over the threshold: those of p = 0.5 or more, else the worst one."""
        found = self.locate(text, 0.0)
        return [s for s in found if s[2] >= 0.5] or sorted(found, key=lambda s: -s[2])[:1]

    def locate(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, p) in code points of the sentences whose own score is ``least`` or more."""
        out, at = [], 0
        if not isinstance(text, str):
            return out
        ends = [(m.start(), m.end()) for m in SENTENCE_END.finditer(text)] + [(len(text), len(text))]
        for stop, after in ends:
            tokens = set(text[at:stop].lower().split())
            if tokens:
                p = 1 / (1 + np.exp(-(self.bias + sum(self.weights.get(f, 0.0) for t in tokens for f in features_of(t)))))
                if p >= least:
                    out.append((at, stop, float(p)))
            at = after
        return out


def learn(texts: list[str], labels: list[int], weight: tuple[float, float] = (1.0, 1.0), rounds: int = 150, features: int = FEATURES) -> Model:
    """Fit the noisy-or of sentences to document labels by gradient descent (Adam, full batch).

    weight: of a clean and of a toxic document, to undo an uneven sample. Without a document of either
    class the model scores by the bias alone.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, -8.0 if not len(y) or y[0] == 0 else 0.0)
    known = functools.lru_cache(200_000)(features_of)
    sentences = lambda text: (set(x.split()) for x in SENTENCE_END.split(text.lower()))
    # only features of three toxic documents or more are counted at all, so that memory follows those
    seen = [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        if label:
            seen[1].update({f for s in sentences(text) for t in s for f in known(t)})
    seen[1] = Counter({f: k for f, k in seen[1].items() if k >= 3})
    for text, label in zip(texts, labels, strict=True):
        if not label:
            seen[0].update({f for s in sentences(text) for t in s for f in known(t) if f in seen[1]})
    n1, n0 = y.sum(), len(y) - y.sum()
    lift = {f: abs(np.log((k + 0.5) / (n1 + 1)) - np.log((seen[0][f] + 0.5) / (n0 + 1))) * np.sqrt(k + seen[0][f]) for f, k in seen[1].items()}
    chosen = sorted(lift, key=lambda f: (-lift[f], f))[:features]
    number = {f: k for k, f in enumerate(chosen)}
    col, sentence, owner, plain = array("i"), array("i"), array("i"), np.zeros(len(texts))
    for d, text in enumerate(texts):
        for s in sentences(text):
            ids = [number[f] for t in s for f in known(t) if f in number]
            if ids:
                col.extend(ids)
                sentence.extend([len(owner)] * len(ids))
                owner.append(d)
            elif s:
                plain[d] += 1
    col, sentence, owner = np.array(col, np.int64), np.array(sentence, np.int64), np.array(owner, np.int64)
    w, each = np.zeros(len(chosen) + 1), np.where(y == 1, weight[1], weight[0])
    w[-1], each = -6.0, each / each.sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, w[col], len(owner)) + w[-1]
        s = np.bincount(owner, softplus(z), len(y)) + plain * softplus(w[-1])
        s = np.maximum(s, 1e-9)
        by_s = each * np.where(y == 1, -1 / np.expm1(np.minimum(s, 50)), 1.0)
        sig = 1 / (1 + np.exp(-z))
        by_z = by_s[owner] * sig
        g = np.append(np.bincount(col, by_z[sentence], len(chosen)), by_z.sum() + (by_s * plain).sum() / (1 + np.exp(-w[-1])))
        g[:-1] += 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    z = np.bincount(sentence, w[col], len(owner)) + w[-1]
    p = -np.expm1(-(np.bincount(owner, softplus(z), len(y)) + plain * softplus(w[-1])))
    order = np.argsort(-p)
    hit, miss = np.cumsum((each * y)[order]), np.cumsum((each * (1 - y))[order])
    best = int(np.argmax(2 * hit / (hit + miss + (each * y).sum())))
    below = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return Model({f: float(x) for f, x in zip(chosen, w[:-1], strict=True)}, float(w[-1]), float(np.clip((p[order[best]] + below) / 2, 1e-6, 1 - 1e-6)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Learn from a sample of at most ``sample`` labelled documents of each class, outside the held-out fold.

    Several labels of one document count as toxic if one is; of several texts under one id the least is learned from. Null ids,
    labels and texts, and texts over ``chars`` characters, are not learned from, and the sample is drawn among the others. Nothing
    of a document but its text is an input; other columns are not looked at, whatever their names.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    fit = docs.select("doc_id", "text").where(F.length("text") <= chars)
    usable = known.join(fit.select("doc_id").distinct(), "doc_id", "left_semi")
    # both samples are bounded, so that they may be broadcast
    picked = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = fit.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    rows = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    got = Counter(r["toxic"] for r in rows)
    weight = tuple(counts.get(k, 0) / max(1, got[k]) for k in (0, 1))
    return learn([r["text"] for r in rows], [r["toxic"] for r in rows], weight)


def score_column(model: Model, spark):
    """A column function from texts to scores in 0 to 1; null and empty texts have no sentence and score 0."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        for batch in texts:
            yield pd.Series([float(one(t)) for t in batch], dtype=float)

    return pandas_udf(score, "double")


JUDGED = "struct<score:double,offending:array<struct<start:long,end:long,p:double>>>"


def judged_column(model: Model, spark):
    """A column function from texts to their score and, from the threshold on, the sentences that give offence (code points)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        one = model.scorer()
        for batch in texts:
            scores = [float(one(t)) for t in batch]
            yield pd.DataFrame({"score": scores, "offending": [model.offending(t) if s >= THRESHOLD else [] for t, s in zip(batch, scores, strict=True)]})

    return pandas_udf(judged, JUDGED)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, offending of every row; null and empty texts score 0.

    Equal texts score equally; repeated rows stay; other columns of ``docs`` are not looked at, whatever their names.
    """
    made = docs.select("doc_id", held_out().alias("held_out"), judged_column(model, docs.sparkSession)("text").alias("judged"))
    predicted = (F.col("judged.score") >= THRESHOLD).cast("int").alias("predicted")
    return made.select("doc_id", "held_out", "judged.score", predicted, "judged.offending")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, by a model that has not seen the held-out labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model)
