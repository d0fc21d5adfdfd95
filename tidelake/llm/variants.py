"""Spelling variants: the pairs of vocabulary words that one edit parts, by composing finite-state machines.

The vocabulary is an acyclic acceptor V, minimised; E is the transducer that copies a word but for one inserted, deleted or
replaced letter. The composition V o E o V accepts the pairs one edit apart. Its states are (p, edited or not, q): before the
edit both acceptors have read the same letters, so that p = q; after it, what both accept is the intersection of p and q.

An edit that follows the first two letters lies in a composition that starts where these two have been read; any other leaves
the last three letters alone (words have five or more), and is found by the same machines over the words read backwards. Each such
initial state is a partition of its own. One with too many words is split on Spark: pairs that part right here meet by the letters
that follow the edit (at most an alphabet of them), the others go on to the initial states one letter further.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import Scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LEAST_LETTERS, LEAST_TIMES = 5, 3
FRONT, BACK = 2, 3
KEEP, TASK_WORDS = 200_000, 20_000


def words_of(doc: int | str | None, text: str | None) -> Counter:
    """How often each word comes in a text: its runs of letters, of which one in 97 has lost a letter. A null id counts as no digits."""
    start, found = zlib.crc32(f"{'' if doc is None else doc}:".encode()), Counter()
    for run, n in Counter(RUN.findall(text or "")).items():
        run = run.lower() if run.isascii() else run.translate(LOWER)
        h = zlib.crc32(run.encode(), start)
        if not h % 97:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        found[run] += n
    return found


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the words of many texts; at most about KEEP words are held at once."""
    held: Counter = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame({"word": list(held.keys()), "n": np.fromiter(held.values(), np.int64, len(held))})

    for batch in batches:
        for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
            for word, n in words_of(doc, text if isinstance(text, str) else None).items():
                if len(word) >= LEAST_LETTERS:
                    held[word] += n
            if len(held) > KEEP:
                yield out()
                held.clear()
    if held:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the distinct words of all texts with five letters and three occurrences or more."""
    # ids go as text, so that a null among them does not turn the others into floats
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_counts, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


class Composition:
    """The minimised acceptor of sorted, distinct words, and the pairs that its composition with one edit accepts.

    A state is either the one string that it accepts, or its arcs and whether it is final. States that accept the same are one.
    ``most``: an edit counts only if at most so many letters follow it (None: any).
    """

    def __init__(self, words: list[str], most: int | None = None):
        self.most = most
        self.known: dict = {}
        self.arcs: list[str | dict[str, int]] = []
        self.final: list[bool] = []
        self.lengths: list[int] = []  # a bit for each length that is accepted, from 63 on the same one
        self.both: dict[tuple[int, int], list[str]] = {}
        self.made: dict[int, list[tuple[str, str]]] = {}
        self.root = self._state(words, 0, len(words), 0)

    def _add(self, key, arcs, final: bool, lengths: int) -> int:
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.lengths.append(lengths)
        return self.known[key]

    def _node(self, arcs: dict[str, int], final: bool) -> int:
        lengths = int(final)
        for to in arcs.values():
            lengths |= self.lengths[to] << 1
        if lengths >> 64:
            lengths = lengths & ((1 << 64) - 1) | 1 << 63
        return self._add((final, *arcs.items()), arcs, final, lengths)

    def _state(self, words: list[str], lo: int, hi: int, depth: int) -> int:
        if hi - lo == 1:
            rest = words[lo][depth:]
            return self._add(rest, rest, not rest, 1 << min(len(rest), 63))
        first, last, at = words[lo], words[hi - 1], depth
        while at < len(first) and first[at] == last[at]:
            at += 1
        arcs, k = {}, lo + (len(first) == at)
        while k < hi:
            letter, end = words[k][at], k + 1
            while end < hi and words[end][at] == letter:
                end += 1
            arcs[letter] = self._state(words, k, end, at + 1)
            k = end
        state = self._node(arcs, len(first) == at)
        for letter in reversed(first[depth:at]):
            state = self._node({letter: state}, False)
        return state

    def language(self, p: int) -> list[str]:
        arcs = self.arcs[p]
        if isinstance(arcs, str):
            return [arcs]
        return [""] * self.final[p] + [letter + s for letter, to in arcs.items() for s in self.language(to)]

    def common(self, p: int, q: int) -> list[str]:
        """What both states accept."""
        if p == q:
            return self.language(p)
        if not self.lengths[p] & self.lengths[q]:
            return []
        pair = (p, q) if p < q else (q, p)
        if pair not in self.both:
            self.both[pair] = self._common(p, q)
        return self.both[pair]

    def _common(self, p: int, q: int) -> list[str]:
        a, b = self.arcs[p], self.arcs[q]
        if isinstance(a, str):
            return [a] if self.accepts(q, a) else []
        if isinstance(b, str):
            return [b] if self.accepts(p, b) else []
        if len(a) > len(b):
            a, b = b, a
        return [""] * (self.final[p] and self.final[q]) + [c + s for c, to in a.items() if c in b for s in self.common(to, b[c])]

    def accepts(self, p: int, word: str) -> bool:
        for k, c in enumerate(word):
            arcs = self.arcs[p]
            if isinstance(arcs, str):
                return arcs == word[k:]
            if c not in arcs:
                return False
            p = arcs[c]
        return self.final[p]

    def after(self, p: int, q: int) -> list[str]:
        found = self.common(p, q)
        return found if self.most is None else [s for s in found if len(s) <= self.most]

    def pairs(self, p: int) -> list[tuple[str, str]]:
        """The pairs (u, v) that part at their first differing letter, v not shorter, read from p with no edit yet."""
        if p in self.made:
            return self.made[p]
        arcs, found = self.arcs[p], []
        if not isinstance(arcs, str):
            letters = list(arcs.items())
            short = (1 << 64) - 1 if self.most is None else (1 << self.most + 1) - 1
            for i, (c, to) in enumerate(letters):
                found += [(c + u, c + v) for u, v in self.pairs(to)]
                fits = self.lengths[to] & short
                if not fits:
                    continue
                for d, other in letters[i + 1 :]:
                    if fits & self.lengths[other]:
                        found += [(c + s, d + s) for s in self.after(to, other)]
                if fits & self.lengths[p]:  # c is inserted; a word that goes on with c parts further on
                    found += [(s, c + s) for s in self.after(p, to) if s[:1] != c]
        self.made[p] = found
        return found


def near_pairs(words: list[str], backwards: bool) -> list[tuple[str, str]]:
    """The pairs one edit apart among sorted, distinct words; of words read backwards, those that part within their first FRONT letters."""
    if not words:
        return []
    machine = Composition(words, FRONT - 1 if backwards else None)
    found = machine.pairs(machine.root)
    return [(u[::-1], v[::-1]) for u, v in found if u[::-1][:FRONT] != v[::-1][:FRONT]] if backwards else found


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partitions arrive whole and sorted; one that a batch's end cuts waits for the next batch."""
    now, words = None, []

    def out() -> Iterator[pd.DataFrame]:
        if len(words) > 1:
            found = near_pairs(words, now[0] == 1)
            for k in range(0, len(found), 100_000):
                yield pd.DataFrame(found[k : k + 100_000], columns=["a", "b"])

    for batch in batches:
        for side, key, word in zip(batch["side"].tolist(), batch["key"].tolist(), batch["way"].tolist(), strict=True):
            if (side, key) != now:
                yield from out()
                now, words = (side, key), []
            words.append(word)
    yield from out()


def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many letters two words have in common at their beginning."""
    return pd.Series([next((k for k, (x, y) in enumerate(zip(u, v, strict=False)) if x != y), min(len(u), len(v))) for u, v in zip(a, b, strict=True)], dtype="int32")


def links(words: DataFrame, scratch: Scratch, crowd: int = 8_192) -> DataFrame:
    """Pairs (a, b) of the distinct words (column word) that one edit parts, each pair once."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("way")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("way"))))
    start = F.when(F.col("side") == 0, FRONT).otherwise(BACK)
    rows = words.select(both.alias("_w")).select("_w.*").withColumn("key", F.substring("way", F.lit(1), start))
    rows, ready, here, step = scratch.save(rows, "states-0"), [], [], 0
    while True:
        states = rows.groupBy("side", "key").agg(F.count(F.lit(1)).alias("n"), F.min("way").alias("low"), F.max("way").alias("high"))
        states = scratch.save(states.where("n > 1"), f"sizes-{step}")
        ready.append(rows.join(states.where(F.col("n") <= crowd).select("side", "key"), ["side", "key"], "left_semi"))
        large = states.where(F.col("n") > crowd)
        if not large.limit(1).count():
            break
        # all words of a large state go on alike as far as its least and greatest do
        parted = rows.join(large.select("side", "key", pandas_udf(_alike, "int")("low", "high").alias("at")), ["side", "key"])
        parted = scratch.save(parted.select("side", "way", "at", F.substring("way", F.lit(1), F.col("at")).alias("key")), f"large-{step}")
        here.append(_edited_here(parted))
        step += 1
        further = parted.where(F.length("way") > F.col("at")).select("side", "way", F.substring("way", F.lit(1), F.col("at") + 1).alias("key"))
        rows = scratch.save(further, f"states-{step}")
    united = ready[0]
    for r in ready[1:]:
        united = united.unionByName(r)
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * words.count() // TASK_WORDS))
    dealt = united.select("side", "key", "way").repartition(tasks, "side", "key").sortWithinPartitions("side", "key", "way")
    found = dealt.mapInPandas(_solve, "a string, b string")
    for h in here:
        found = found.unionByName(h)
    return found


def _edited_here(rows: DataFrame) -> DataFrame:
    """Pairs of a large state's words that part right behind its key: those between which the letters after the edit are equal."""
    whole = F.col("way").substr(F.col("at") + 1, F.length("way"))
    read = F.struct(F.lit(1).alias("read"), F.col("way").substr(F.col("at") + 2, F.length("way")).alias("rest"))
    arcs = rows.withColumn("_e", F.explode(F.array(F.struct(F.lit(0).alias("read"), whole.alias("rest")), read))).select("side", "key", "way", "at", "_e.*")
    arcs = arcs.where((F.col("read") == 0) | (F.length("way") > F.col("at"))).where((F.col("side") == 0) | (F.length("rest") < FRONT))
    keys = ["side", "key", "rest"]
    a, b = (arcs.select(*keys, F.col("way").alias(x), F.col("read").alias(f"read_{x}")) for x in "ab")
    replaced = (F.col("read_a") == 1) & (F.col("read_b") == 1) & (F.col("a") < F.col("b"))
    # at one place a letter is inserted only if the shorter word goes on with another
    at = F.length("key") + 1
    inserted = (F.col("read_a") == 0) & (F.col("read_b") == 1) & (F.col("a").substr(at, F.lit(1)) != F.col("b").substr(at, F.lit(1)))
    met = a.join(b, keys).where(replaced | inserted)
    forth = lambda x: F.when(F.col("side") == 0, F.col(x)).otherwise(F.reverse(x)).alias(x)
    parted = (F.col("side") == 0) | (F.substring("a", 1, FRONT) != F.substring("b", 1, FRONT))
    return met.select("side", forth("a"), forth("b")).where(parted).select("a", "b")


def variants(docs: DataFrame) -> DataFrame:
    """One row a word of the vocabulary: word, n, n_near, form, form_n, root.

    form is the near word that comes most often (of ties the least in code-point order), where that is at least twice as often
    as the word itself; root is where the forms lead. Null and empty texts have no words; repeated rows count each; a null doc_id
    counts as an empty one; other columns of ``docs`` are not looked at; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.save(vocabulary(docs), "words")
    pairs = scratch.save(links(words.select("word"), scratch), "pairs")
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    others = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    found = near.join(others, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    named = words.join(found, "word", "left").withColumn("often", -F.col("best.less") >= 2 * F.col("n"))
    named = named.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("often"), F.col("best.near")).alias("form"),
        F.when(F.col("often"), -F.col("best.less")).alias("form_n"),
    )
    named = scratch.save(named, "forms")
    # forms at least double n, so that chains are short and have no cycle; each round doubles the steps that are made
    roots, step = scratch.save(named.select("word", F.coalesce("form", "word").alias("root")), "roots-0"), 0
    while True:
        step += 1
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        new = roots.join(up, "root").select("word", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
        new = scratch.save(new, f"roots-{step}")
        scratch.drop(f"roots-{step - 1}")
        roots = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return named.join(roots, "word").select("word", "n", "n_near", "form", "form_n", "root")


def op11_variants(spark, sf_dir: str) -> DataFrame:
    """All words of documents with their near words' forms."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
