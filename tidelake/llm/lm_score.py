"""Language-model scoring by cross-entropy difference.

Two bigram models share one vocabulary, all words of all documents: the target model counts the documents
labelled good, the background model all documents. A token's loss is its negative log probability after the
token before it; a document's score is the mean over its tokens of target loss less background loss, so
that a lower score stands nearer to the target.

Both models: P(w|h) = (c(h,w) + MU * P(w)) / (c(h) + MU), P(w) = (c(w) + 1) / (N + number of words + 1).
Nothing is cut: the vocabulary and the pairs grow with the corpus, and are never in one place.

Documents are dealt to cells. A cell asks for the counts that it needs: once for each distinct pair and word
in it, with its own counts (how often a word ends a document tells how often it is a context), under the key's hash (48 bits of it and its bucket
are compared: two keys that agree in both would be counted as one, which of a million keys in a bucket happens to a pair in one bucket of 560). Tasks that each own a range of hashes add up what all cells
say and answer every question; the cells then score their documents. A pair that all documents have is asked
for once a cell, so that no task gets more of it than there are cells.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import words_of
from .shared import ODD, Scratch, WordHashes, bucket_of, cell_of, dealt, mix, row_number, text_of

MU = 2.0
CELL_BITS, LONG = 10, 1 << 16
#: Bytes of text whose pairs make a bucket; words and contexts are fewer.
BUCKET_BYTES = 20_000_000
START = np.uint64(0)
PAIRS, WORDS, STARTS = KINDS = range(3)
COUNTS = ("n", "target_n", "ends", "target_ends")


_hashes = WordHashes()


class _Cell:
    """The tokens of a cell's texts, and the keys of their counts: for each kind the distinct keys in order."""

    def __init__(self, texts):
        words, sizes = [], []
        for t in texts:
            w = words_of(t)
            words += w
            sizes.append(len(w))
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        word = _hashes.of(words)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        ends = np.cumsum(self.sizes)[self.sizes > 0]
        self.first, self.last = np.zeros(len(word), bool), np.zeros(len(word), bool)
        self.first[ends - self.sizes[self.sizes > 0]], self.last[ends - 1] = True, True
        context[self.first] = START
        self.orders, self.firsts, self.keys = [], [], []
        for key in (mix(context * ODD[0] + word * ODD[1] + ODD[2]), word):
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))[: len(key)]
            self.orders.append(order)
            self.firsts.append(first)
            self.keys.append(key[order[first]])

    def totals(self, kind: int, each: np.ndarray) -> np.ndarray:
        """Sums of a token's values by distinct key."""
        return np.add.reduceat(each[self.orders[kind]], self.firsts[kind]) if len(each) else np.zeros(0, each.dtype)

    def spread(self, kind: int, values: np.ndarray) -> np.ndarray:
        """A value of each distinct key, for every token."""
        out = np.empty(len(self.doc))
        out[self.orders[kind]] = np.repeat(values, np.diff(np.append(self.firsts[kind], len(self.doc))))
        return out


def _small(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, first all lowest bytes, so that the others compress; none if all are 0."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    return values.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T.tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, plane in enumerate(np.frombuffer(data, "u1").reshape(-1, n) if data else ()):
        out |= plane.astype(np.int64) << 8 * k
    return out


QUESTIONS = "kind int, bucket int, cell long, first long, last long, keys binary, n binary, target_n binary, ends binary, target_ends binary"
ANSWERS = "cell long, first long, last long, kind int, bucket int, n binary, target_n binary, ends binary, target_ends binary, " \
    "distinct long, tokens long, target_tokens long, starts long, target_starts long"


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each cell, or of the part of it that this task reads."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        cell = batch["cell"].to_numpy()
        for a, b in zip([0, *(cuts := (np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist())], [*cuts, len(cell)], strict=True):
            if held and a < b and held[0]["cell"].iat[0] != cell[a]:
                yield pd.concat(held)
                held = []
            if a < b:
                held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held)


def _ask(buckets: list[int]):
    columns = [c.split()[0] for c in QUESTIONS.split(", ")]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs in _cells(batches):
            cell, row = _Cell(docs["text"]), docs["row"]
            good, last = docs["good"].to_numpy(bool)[cell.doc].astype(np.int64), cell.last.astype(np.int64)
            named = {"cell": docs["cell"].iat[0], "first": row.min(), "last": row.max()}
            for kind in (PAIRS, WORDS):
                keys, each = cell.keys[kind], [np.ones_like(good), good]
                counts = dict(zip(COUNTS, [cell.totals(kind, x) for x in [*each, last, last * good][: 4 if kind == WORDS else 2]], strict=False))
                low, high = (keys & np.uint64((1 << 32) - 1)).astype("u4"), (keys >> np.uint64(32)).astype("u2")  # 48 bits, and the bucket
                frame = dealt("bucket", bucket_of(keys, buckets[kind]), {"low": low, "high": high} | counts)
                for c in COUNTS:
                    frame[c] = [_small(np.frombuffer(x, np.int64)) for x in frame[c]] if c in counts else b""
                frame["keys"] = frame.pop("low") + frame.pop("high")
                yield frame.assign(kind=kind, **named)[columns]
            starts = [_small(np.array([x])) for x in (cell.first.sum(), (cell.first * good).sum())]
            yield pd.DataFrame([named | {"kind": STARTS, "bucket": int(row.min()) % buckets[WORDS], "keys": b"", "n": starts[0], "target_n": starts[1], "ends": b"", "target_ends": b""}])[columns]

    return ask


def _keys(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "u4", n).astype(np.uint64) | np.frombuffer(data, "u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Questions arrive sorted by kind and bucket. Each gets the sums over all questions; a bucket of words also says how many there are."""

    columns = [c.split()[0] for c in ANSWERS.split(", ")]

    def settle(asked: list[tuple]) -> pd.DataFrame:
        kind, bucket = asked[0][:2]
        if kind == STARTS:
            starts = [sum(int(_large(q[c], 1)[0]) for q in asked) for c in (6, 7)]
            return pd.DataFrame([(*[None] * 3, kind, bucket, *[None] * 7, *starts)], columns=columns).astype(whole)
        keys = [_keys(q[5]) for q in asked]
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.zeros(len(key), np.int64) for _ in COUNTS]
        for c in range(4 if kind == WORDS else 2):
            np.add.at(sums[c], where, np.concatenate([_large(q[6 + c], len(k)) for q, k in zip(asked, keys, strict=True)]))
        cuts = np.append(0, np.cumsum([len(k) for k in keys])).tolist()
        told = [where[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        out = [(*q[2:5], kind, bucket, *[_small(x[w]) for x in sums], *[None] * 5) for q, w in zip(asked, told, strict=True)]
        if kind == WORDS:
            out.append((*[None] * 3, kind, bucket, *[None] * 4, len(key), int(sums[0].sum()), int(sums[1].sum()), None, None))
        return pd.DataFrame(out, columns=columns).astype(whole)

    whole = {c: "Int64" for c in columns if c not in ("kind", "bucket", *COUNTS)}
    asked: list[tuple] = []
    for batch in batches:
        for q in batch.itertuples(index=False, name=None):
            if asked and q[:2] != asked[0][:2]:
                yield settle(asked)
                asked = []
            asked.append(q)
    if asked:
        yield settle(asked)


def _score(totals: dict[str, int], buckets: list[int]):
    size = totals["distinct"] + 1

    def part(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Losses of the documents that asked together. Buckets are ranges of the keys, so that answers in their order are in the keys' order."""
        cell, losses = _Cell(docs["text"]), []
        each = [np.unique(bucket_of(cell.keys[kind], buckets[kind]), return_counts=True)[1].tolist() for kind in (PAIRS, WORDS)]
        answers = [told[told["kind"] == kind].sort_values("bucket") for kind in (PAIRS, WORDS)]

        def counts(kind: int, column: str) -> np.ndarray:
            parts = [_large(x, k) for x, k in zip(answers[kind][column], each[kind], strict=True)]
            return cell.spread(kind, np.concatenate(parts)) if parts else np.zeros(0)

        for which in ("", "target_"):
            pair, word = counts(PAIRS, f"{which}n"), counts(WORDS, f"{which}n")
            context = np.append(0.0, word - counts(WORDS, f"{which}ends"))[: len(word)]  # of the token before
            context[cell.first] = totals[f"{which}starts"]
            p = (pair + MU * (word + 1) / (totals[f"{which}tokens"] + size)) / (context + MU)
            losses.append(np.bincount(cell.doc, -np.log(p), len(docs)))
        n = np.maximum(cell.sizes, 1)
        return pd.DataFrame({"doc_id": docs["doc_id"], "none": docs["none"], "n_tokens": cell.sizes, "target_loss": losses[1] / n, "background_loss": losses[0] / n})

    def score(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        asked, parts = answers.groupby(["first", "last"]), []
        for (first, last), told in asked:
            parts.append(part(docs[docs["row"].between(first, last)].sort_values("row"), told.drop_duplicates(["kind", "bucket"])))
        # without any word in a part, nothing was asked
        rest = docs[~docs["row"].isin(pd.concat([docs["row"][docs["row"].between(*k)] for k, _ in asked]))] if parts else docs
        return pd.concat([*parts, part(rest, answers.iloc[:0])])

    return score


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score. target: the doc_ids of the target corpus.

    A document without tokens (null and empty texts) has 0 tokens and null losses and score. Repeated rows are
    scored each, and counted as often as they come; repeated target ids count once; null ids are no target.
    Without target documents the target model is the uniform one over the vocabulary. Other columns are not
    looked at, whatever their names. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", text_of().alias("text"))
    ids = target.select("doc_id").where("doc_id is not null").distinct().withColumn("good", F.lit(True))
    # the same plan at every size: which side is small depends on the labels
    known = docs.where("doc_id is not null").join(ids.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    marked = known.unionByName(docs.where("doc_id is null").withColumn("good", F.lit(False)))
    size = F.octet_length("text")
    rows = scratch.save(marked.select("doc_id", "text", "good", size.cast("long").alias("bytes"), row_number(size, CELL_BITS, LONG)), "rows")
    cell = cell_of("row", CELL_BITS)
    # pandas has no null among whole numbers: a null id travels as 0 with a mark
    texts = rows.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text", "row", cell)
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    most = max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_BYTES))
    buckets = [most, -(-most // 8)]
    asked = rows.select("text", "good", "row", cell).mapInPandas(_ask(buckets), QUESTIONS)
    answers = asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInPandas(_answer, ANSWERS)
    answers = scratch.save(answers, "answers")
    names = ("distinct", "tokens", "target_tokens", "starts", "target_starts")
    sums = answers.where("cell is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    made = _score(sums.asDict(), buckets)
    told = answers.where("cell is not null").drop(*names)
    out = texts.groupBy("cell").cogroup(told.groupBy("cell")).applyInPandas(made, "doc_id long, none boolean, n_tokens long, target_loss double, background_loss double")
    loss = lambda c: F.when(F.col("n_tokens") > 0, F.col(c)).alias(c)
    return out.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "n_tokens", loss("target_loss"), loss("background_loss")).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    """All documents scored against those labelled of good quality."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


OP8_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws,
                 doc_id in (select doc_id from labels where quality = 1) as good from documents),
t as (select doc_id, good, unnest(ws) as word, unnest(range(len(ws))) as pos from d),
v as (select count(distinct word) + 1 as size from t),
p as (select doc_id, good, word, coalesce(lag(word) over (partition by doc_id order by pos), '<s>') as prev from t),
hw as (select prev, word, count(*) as n, count(*) filter (where good) as nt from p group by all),
h as (select prev, sum(n) as n, sum(nt) as nt from hw group by prev),
w as (select word, sum(n) as n, sum(nt) as nt from hw group by word),
tot as (select sum(n) as n, sum(nt) as nt from hw),
loss as (select hw.prev, hw.word,
                -ln((hw.nt + 2.0 * (w.nt + 1) / (tot.nt + v.size)) / (h.nt + 2.0)) as lt,
                -ln((hw.n + 2.0 * (w.n + 1) / (tot.n + v.size)) / (h.n + 2.0)) as lb
         from hw join h using (prev) join w using (word), tot, v),
s as (select p.doc_id, count(*) as n_tokens, avg(lt) as lt, avg(lb) as lb from p join loss using (prev, word) group by p.doc_id)
select d.doc_id, coalesce(n_tokens, 0)::bigint as n_tokens, round(lt, 6) as target_loss, round(lb, 6) as background_loss, round(lt - lb, 6) as score
from d left join s using (doc_id)
"""
