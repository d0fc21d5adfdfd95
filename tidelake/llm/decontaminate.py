"""Benchmark decontamination: a prefix-filtered set join, verified over item-sized windows.

The tokens of a window are its word shingles. Tokens are ordered by how rare they are in all documents.
A window lies in a document only if all its tokens do, so that the necessary prefix of the ordered
tokens is the rarest one: it alone is joined with the documents' tokens. A match fixes where the
window would have to begin; begins outside the document, or in documents too short for it, are given
up, and what is left is compared word by word.

The benchmark is the stated query set: its windows are taken in blocks of bounded bytes, and each
block is joined inside one pass over the documents, without a shuffle. Any number of blocks is exact: beyond
the first, the documents are written once, each block writes only the rows that it hits, and these are joined back at the end.
"""

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import Scratch

#: Bytes that are no part of a word count as blanks, A-Z as a-z.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
HITS = "struct<n_words:long,spans:array<struct<start:long,stop:long>>,items:array<string>>"
FOUND = "_row long, spans array<struct<start:long,stop:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if isinstance(text, str) else []


def found_in(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


class Windows:
    """The distinct windows of one length: where each stands in the block's words, and the items that have it."""

    def __init__(self, flat: np.ndarray, length: int, starts: np.ndarray, owner: np.ndarray, shingle: int):
        self.length, self.size = length, min(shingle, length)
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, length)[starts])
        _, first, which = np.unique(rows.view(np.dtype((np.void, rows.itemsize * length))).ravel(), return_index=True, return_inverse=True)
        self.start = starts[first].astype(np.int32)
        pairs = np.unique((which.astype(np.int64) << 32) | owner)
        self.items = (pairs & 0xFFFFFFFF).astype(np.int32)
        self.begin = np.searchsorted(pairs >> 32, np.arange(len(first) + 1)).astype(np.int32)

    def order(self, tokens: np.ndarray, rank: np.ndarray) -> None:
        """Sort the windows by the rarest of their shingles (``rank`` by place in the block) and keep where it stands."""
        inside = np.lib.stride_tricks.sliding_window_view(rank, self.length - self.size + 1)
        at = np.concatenate([inside[part].argmin(axis=1) for part in np.array_split(self.start, len(self.start) // 100_000 + 1)])
        key = tokens[self.start + at]
        self.by_key = np.argsort(key, kind="stable").astype(np.int32)
        self.key, self.at = key[self.by_key], at[self.by_key].astype(np.int8)


class Block:
    """The windows of some benchmark items, indexed by the rarest shingle of each: flat arrays of numbers.

    Words are numbered; a shingle is three word numbers in one integer, a shorter window is its own shingle.
    """

    def __init__(self, window: int, shingle: int = 3):
        self.window, self.shingle, self.words = window, shingle, {}
        self.names: list[str] = []
        self.held, self.lengths = array("i"), array("q")

    def add(self, item: str, words: list[bytes]) -> None:
        self.names.append(item)
        self.lengths.append(len(words))
        self.held.extend([self.words.setdefault(w, len(self.words) + 1) for w in words])
        self.held.append(0)  # no shingle goes from one item to the next

    def close(self) -> None:
        self.flat, lengths = np.array(self.held, np.int32), np.array(self.lengths, np.int64)
        self.base = len(self.words) + 1
        begins = np.cumsum(lengths + 1) - lengths - 1
        size = np.minimum(lengths, self.window)
        self.groups = []
        for length in np.unique(size).tolist():
            owners = np.flatnonzero(size == length)
            n = lengths[owners] - length + 1
            owner = np.repeat(owners, n)
            starts = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + begins[owner]
            self.groups.append(Windows(self.flat, length, starts, owner, self.shingle))
        self.sizes = sorted({g.size for g in self.groups})
        found = np.unique(np.concatenate([self.shingles(self.flat, k) for k in self.sizes]))
        self.tokens = found[found > 0]
        del self.held, self.lengths

    def shingles(self, ids: np.ndarray, size: int | None = None) -> np.ndarray:
        """Shingles of ``size`` words each; one with an unknown word is 0. Sizes never share a number."""
        size = size or self.shingle
        n = max(0, len(ids) - size + 1)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(size):
            out = out * self.base + ids[k : k + n]
            known &= ids[k : k + n] > 0
        return np.where(known, out, 0)

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, 0 for unknown words and between texts; where each text begins."""
        get, out, begins = self.words.get, [], []
        for text in texts:
            begins.append(len(out))
            out += [get(w, 0) for w in words_of(text)]
            out.append(0)
        return np.array(out, np.int64), np.array([*begins, len(out)], np.int64)

    def order(self, counts: np.ndarray) -> None:
        """Keep of each window only the necessary prefix: its rarest shingle by ``counts`` of the tokens, and where that stands in it."""
        rank = np.empty(len(self.tokens), np.int32)
        rank[np.lexsort((self.tokens, counts))] = np.arange(len(counts), dtype=np.int32)
        for size in self.sizes:
            here = self.shingles(self.flat, size)
            there = np.where(here > 0, rank[np.minimum(np.searchsorted(self.tokens, here), len(rank) - 1)], np.int32(1 << 30)).astype(np.int32)
            for g in self.groups:
                if g.size == size:
                    g.order(here, there)

    def search(self, ids: np.ndarray, begins: np.ndarray, most: int = 1_000_000) -> dict[int, tuple[set[tuple[int, int]], set[str]]]:
        """For each text with occurrences: spans of words inside them, and the items of the windows."""
        found: dict[int, tuple[set, set]] = {}
        for g in self.groups:
            tokens = self.shingles(ids, g.size)
            hits = np.flatnonzero(found_in(g.key, tokens)) if len(tokens) else np.empty(0, np.int64)
            low, high = (np.searchsorted(g.key, tokens[hits], side) for side in ("left", "right"))
            total = np.cumsum(high - low)
            for a, b in _slices(total, most):
                n = (high - low)[a:b]
                k = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())  # each window whose shingle this is
                start = np.repeat(hits[a:b], n) - g.at[k]
                row = np.searchsorted(begins, np.repeat(hits[a:b], n), side="right") - 1
                there = (start >= begins[row]) & (start + g.length < begins[row + 1])  # positional and length bounds
                k, start, row = g.by_key[k[there]], start[there], row[there]
                for d in range(g.length):
                    same = ids[start + d] == self.flat[g.start[k] + d]
                    k, start, row = k[same], start[same], row[same]
                for w, s, r in zip(k.tolist(), (start - begins[row]).tolist(), row.tolist(), strict=True):
                    spans, items = found.setdefault(r, (set(), set()))
                    spans.add((s, s + g.length))
                    items.update(self.names[i] for i in g.items[g.begin[w] : g.begin[w + 1]])
        return found


def _slices(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of a running total that each add at most ``most``, or are one entry."""
    a = 0
    while a < len(total):
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + most, side="right")))
        yield a, b
        a = b


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def blocks_of(benchmark: DataFrame, window: int = 13, words_per_block: int = 1_000_000) -> Iterator[Block]:
    """Read the benchmark row by row and cut it into blocks; one block at a time is in memory.

    A word takes about 30 bytes of a block, in the driver and in each Python worker, and the block's different words about
    150 bytes each. Items without words have no windows; a null id is named ''.
    """
    block, size = Block(window), 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        words = words_of(r["text"])
        while words:  # an item longer than a block goes on, overlapping by a window less one, in the next
            room = max(window, words_per_block - size)
            block.add(r["item"] or "", words[:room])
            size += len(words[:room])
            words = words[room - window + 1 :] if len(words) > room else []
            if size >= words_per_block:
                block.close()
                yield block
                block, size = Block(window), 0
    if size:
        block.close()
        yield block


def _rarities(docs: DataFrame, block) -> np.ndarray:
    """How often each shingle of the block stands in all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = block.value
        totals = np.zeros(len(b.tokens), np.int64)
        for batch in batches:
            ids, _ = b.ids(batch["text"])
            for size in b.sizes:
                t = b.shingles(ids, size)
                np.add.at(totals, np.searchsorted(b.tokens, t[found_in(b.tokens, t)]), 1)
        seen = np.flatnonzero(totals)
        yield pd.DataFrame({"token": b.tokens[seen], "n": totals[seen]})

    tokens, out = block.value.tokens, np.zeros(len(block.value.tokens), np.int64)
    counted = docs.select("text").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    seen = counted.toPandas()  # at most as many rows as the block has shingles
    out[np.searchsorted(tokens, seen["token"].to_numpy(np.int64))] = seen["n"]
    return out


def _hits(block):
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            ids, begins = block.value.ids(batch)
            found = block.value.search(ids, begins)
            rows = [(int(n) - 1, merged(found[k][0]), sorted(found[k][1])) if k in found else (int(n) - 1, [], []) for k, n in enumerate(np.diff(begins))]
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return pandas_udf(hits, HITS)


def _found(block):
    """Like ``_hits``, but only of the texts with hits, beside the number of their row."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = block.value.search(*block.value.ids(batch["text"]))
            rows = [(int(batch["_row"].iat[k]), merged(spans), sorted(items)) for k, (spans, items) in seen.items()]
            yield pd.DataFrame(rows, columns=["_row", "spans", "items"])

    return found


def _summary(hits: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for words, found, named in zip(hits["n_words"], hits["spans"], hits["items"], strict=True):
        spans = merged([(int(s["start"]), int(s["stop"])) for s in found])
        items = sorted(set(named))
        n = sum(b - a for a, b in spans)
        rows.append((int(words), n, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n > 0 and 20 * n >= int(words), spans))
    return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, words_per_block: int = 1_000_000, out: str = "_hits") -> DataFrame:
    """``docs`` with a column named ``out``: n_words, n_hit, n_items, items_sha256, contaminated, spans (of words).

    Null and empty texts have no words and no hits; repeated rows and repeated items are taken as they
    come; an empty benchmark hits nothing. Other columns stay, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    made, later = rows, []
    for k, block in enumerate(blocks_of(benchmark, window, words_per_block)):
        unordered = spark.sparkContext.broadcast(block)
        block.order(_rarities(docs, unordered))
        unordered.unpersist()
        shared = spark.sparkContext.broadcast(block)
        if k == 0:
            made = made.withColumn("_h", _hits(shared)(text))
            continue
        if k == 1:  # later blocks read this table, and only what they find is written
            made = scratch.save(made.withColumn("_row", F.monotonically_increasing_id()), "docs")
        found = made.select("_row", F.col(text).alias("text")).mapInPandas(_found(shared), FOUND)
        later.append(scratch.save(found, f"hits-{k}"))
        shared.unpersist()
    if later:
        more = functools.reduce(DataFrame.unionByName, later).groupBy("_row")  # at most a row a block
        both = more.agg(*[F.flatten(F.collect_list(c)).alias(f"_{c}") for c in ("spans", "items")])
        joined = [F.concat(f"_h.{c}", F.coalesce(f"_{c}", F.array())).alias(c) for c in ("spans", "items")]
        made = made.join(both, "_row", "left").select(*rows.columns, F.struct("_h.n_words", *joined).alias("_h"))
    if "_h" not in made.columns:  # no block, so no window
        empty = pandas_udf(lambda t: pd.DataFrame({"n_words": [len(words_of(x)) for x in t], "spans": [[]] * len(t), "items": [[]] * len(t)}), HITS, functionType=200)
        made = made.withColumn("_h", empty(text))
    summary = pandas_udf(_summary, "struct<n_words:long,n_hit:long,n_items:long,items_sha256:string,contaminated:boolean,spans:array<struct<start:long,stop:long>>>")
    return made.withColumn("_h", summary("_h")).toDF(*names, out)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", *[f"_hits.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


OP4_SQL = r"""
with words as (select translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t, doc_id from documents),
d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from words),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null),
bp as (select item_id, ws, least(13, len(ws)) as size, unnest(range(greatest(1, len(ws) - 12))) as k from b where len(ws) > 0),
win as (select distinct item_id, size, ws[k + 1 : k + size] as win from bp),
dp as (select doc_id, ws, size, unnest(range(greatest(0, len(ws) - size + 1))) as s from d, (select distinct size from win)),
hit as (select doc_id, s, dw.size, item_id from (select doc_id, s, size, ws[s + 1 : s + size] as win from dp) dw join win on dw.win = win.win and dw.size = win.size),
covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + size)) as pos from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""
