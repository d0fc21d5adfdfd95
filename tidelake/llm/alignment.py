"""Alignment of two tokenizers over whole texts: groups between shared cuts, links of overlapping tokens, how common each link is.

A token ends at a byte offset; offsets where tokens of both end are cuts. They are found by divide and conquer: the end nearest to the
middle of an interval that bisection finds among the other tokenizer's ends parts it in two, and both halves are done alike; an interval in which there is
none is a leaf, one group. The intervals of one depth of all texts of a chunk are handled together, in arrays.

A pair of ids takes 32 bits. Texts keep their distinct pairs; the number of texts that hold each is summed on Spark. Then the counts go back
to the texts: those of the most common pairs, at most HOT of them, as arrays that every task gets, all others by a join.
"""

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Fixed value: the published pattern by which byte-level BPE of this kind parts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_BYTES = 1 << 20
HOT, HELD = 1 << 19, 1 << 21


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others for those from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b if b in plain else next(others)): b for b in range(256)}


class ByteTokens:
    """Tokenizer A: ids by a byte-level BPE's JSON file, and the bytes of each id.

    Where the file's merges stand in the order of their ids, the ids are ranks, and texts of Latin letters and signs (of which
    all Unicode tables know the same) take the faster of two encoders for such files; all others take the file's own.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        model = json.loads(self.own.to_str())["model"]
        letters = _byte_letters()
        special = {t.content for t in self.own.get_added_tokens_decoder().values()}
        plain = {word: k for word, k in model["vocab"].items() if word not in special}
        self.bytes = {k: bytes(letters[c] for c in word) for word, k in plain.items()}
        self.bytes |= {k: t.content.encode() for k, t in self.own.get_added_tokens_decoder().items()}
        merged = [plain["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.fast = None
        if merged == sorted(merged) and not model.get("ignore_merges"):
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={self.bytes[k]: k for k in plain.values()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        simple = self.fast and (lambda t: t.isascii() or max(t) < "ɐ")
        return [self.fast.encode_ordinary(t) if simple and simple(t) else self.own.encode(t, add_special_tokens=False).ids for t in texts]


class PieceTokens:
    """Tokenizer B: ids by a sentencepiece model, which puts a space before the text, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = {k: bytes([int(self.model.id_to_piece(k)[3:5], 16)]) if self.model.is_byte(k) else self.model.id_to_piece(k).replace("▁", " ").encode() for k in range(n)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.cache
def tokenizers(a: str, b: str) -> tuple[ByteTokens, PieceTokens]:
    both = ByteTokens(a), PieceTokens(b)
    if any(max(t.bytes) >= 1 << 16 for t in both):
        raise ValueError("ids of over 16 bits")
    return both


def lengths(table: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(1 << 16, np.int64)
    out[list(table)] = [len(v) for v in table.values()]
    return out


def cuts(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in ``a`` and ``b`` (increasing ends) of the ends that both have; last_a, last_b: known ones, each text's last tokens."""
    found_a, found_b = [last_a], [last_b]
    lo_a, lo_b = (np.concatenate([[0], last[:-1] + 1]) for last in (last_a, last_b))
    hi_a, hi_b = last_a, last_b  # an interval's own last tokens end at a cut already
    while True:
        open_ = (hi_a > lo_a) & (hi_b > lo_b)
        lo_a, hi_a, lo_b, hi_b = (x[open_] for x in (lo_a, hi_a, lo_b, hi_b))
        if not len(lo_a):
            break
        middle, at_a, at_b = (lo_a + hi_a - 1) // 2, np.full(len(lo_a), -1), np.full(len(lo_a), -1)
        left, step = np.arange(len(lo_a)), 0
        while len(left):
            tried = middle[left] + (step + 1) // 2 * (1 if step % 2 else -1)  # outward from the middle, by turns
            inside = (tried >= lo_a[left]) & (tried < hi_a[left])
            k, tried = left[inside], tried[inside]
            place = np.searchsorted(b, a[tried])
            hit = b[place] == a[tried]
            at_a[k[hit]], at_b[k[hit]] = tried[hit], place[hit]
            step += 1
            reach = (step + 1) // 2
            left = left[(at_a[left] < 0) & ((middle[left] + reach < hi_a[left]) | (middle[left] - reach >= lo_a[left]))]
        split = at_a >= 0
        cut_a, cut_b = at_a[split], at_b[split]
        found_a.append(cut_a)
        found_b.append(cut_b)
        lo_a, hi_a, lo_b, hi_b = (np.concatenate(x) for x in (
            (lo_a[split], cut_a + 1), (cut_a, hi_a[split]), (lo_b[split], cut_b + 1), (cut_b, hi_b[split]),
        ))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


@functools.cache
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of all ids of 16 bits, from the left, with room for a sign behind them; and how many they are."""
    text = [str(k).encode() for k in range(1 << 16)]
    return np.array([list(t.ljust(6, b"\0")) for t in text], np.uint8), np.array([len(t) for t in text])


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The groups as ``a1,a2|b1;a3|b2,b3;``, and where each group ends in it."""
    n_a, n_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    before_b, upto_a = np.concatenate([[0], np.cumsum(n_b)[:-1]]), np.cumsum(n_a)
    place_a = np.arange(len(ids_a)) + np.repeat(before_b, n_a)
    place_b = np.arange(len(ids_b)) + np.repeat(upto_a, n_b)
    total = len(ids_a) + len(ids_b)
    ids, signs = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    signs[place_a[cut_a]], signs[place_b[cut_b]] = ord("|"), ord(";")
    digits, count = _digits()
    rows, n = digits[ids], count[ids]
    rows[np.arange(total), n] = signs
    ends = np.cumsum(n + 1)
    return rows[np.arange(6) <= n[:, None]].tobytes(), ends[place_b[cut_b]]


def align(texts: list[str | None], a: ByteTokens, b: PieceTokens) -> Iterator[dict]:
    """For each text its counts, the digest of its groups, and its distinct pairs (a id << 16 | b id) with how often each is linked."""
    empty = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": b"", "times": b""}
    there = [k for k, t in enumerate(texts) if t]
    spaced = [" " + texts[k] for k in there]
    made = []
    for k, text, x, y in zip(there, spaced, a.encode(spaced), b.encode([t[1:] for t in spaced]), strict=True):
        raw = text.encode()
        if b"".join(map(a.bytes.__getitem__, x)) == raw == b"".join(map(b.bytes.__getitem__, y)):
            made.append((k, x, y))
    out = [empty] * len(texts)
    if made:
        ids_a, ids_b = (np.concatenate([np.array(m[side], np.int64) for m in made]) for side in (1, 2))
        last_a, last_b = (np.cumsum([len(m[side]) for m in made]) - 1 for side in (1, 2))
        end_a, end_b = np.cumsum(lengths_of(a)[ids_a]), np.cumsum(lengths_of(b)[ids_b])
        cut_a, cut_b = cuts(end_a, end_b, last_a, last_b)
        written, stops = written_groups(ids_a, ids_b, cut_a, cut_b)
        group_stop = np.searchsorted(cut_a, last_a)
        n_groups = np.diff(group_stop, prepend=-1)
        # between two neighbouring ends of either lies what one token of each have in common: a link
        size = int(end_a[-1]) + 1
        is_a, is_b = np.zeros(size, np.int64), np.zeros(size, np.int64)
        is_a[end_a], is_b[end_b] = 1, 1
        ends = np.flatnonzero(is_a | is_b)
        of_a, of_b = ((np.cumsum(x) - x)[ends] for x in (is_a, is_b))
        text_of = np.searchsorted(end_a[last_a], ends)
        keys, times = np.unique(text_of << 32 | ids_a[of_a] << 16 | ids_b[of_b], return_counts=True)
        n_links = np.bincount(text_of, minlength=len(made))
        first = np.searchsorted(keys, np.arange(len(made) + 1) << 32)
        start = 0
        for m, (k, x, y) in enumerate(made):
            stop, own = int(stops[group_stop[m]]), slice(first[m], first[m + 1])
            out[k] = {
                "n_a": len(x), "n_b": len(y), "n_groups": int(n_groups[m]), "n_links": int(n_links[m]), "groups_sha256": hashlib.sha256(written[start : stop - 1]).hexdigest(),
                "pairs": (keys[own] & 0xFFFFFFFF).astype(np.uint32).tobytes(), "times": times[own].astype(np.uint32).tobytes(),
            }
            start = stop
    yield from out


@functools.cache
def lengths_of(tokens) -> np.ndarray:
    return lengths(tokens.bytes)


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
TEXTS = "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = tokenizers(path_a, path_b)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            sizes = np.cumsum([len(t or "") for t in texts]) // CHUNK_BYTES
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
                if len(part):
                    rows = pd.DataFrame(list(align([texts[k] for k in part], a, b)))
                    yield pd.concat([batch[["row", "doc_id"]].iloc[part].reset_index(drop=True), rows], axis=1)

    return run


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts each pair is; at most about HELD pairs are held at once."""
    pairs, counts, waiting, size = np.empty(0, np.uint32), np.empty(0, np.int64), [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.empty(0, np.uint32), np.empty(0, np.int64))
        every, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
        return every, np.bincount(place, np.concatenate([counts, n]), len(every)).astype(np.int64)

    for batch in batches:
        for x in batch["pairs"]:
            waiting.append(np.frombuffer(x, np.uint32))
            size += len(waiting[-1])
            if size > HELD:
                (pairs, counts), waiting, size = added(), [], 0
                if len(pairs) > HELD:
                    yield pd.DataFrame({"pair": pairs.astype(np.int64), "n": counts})
                    pairs, counts = pairs[:0], counts[:0]
    pairs, counts = added()
    yield pd.DataFrame({"pair": pairs.astype(np.int64), "n": counts})


def _look_up(hot):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a text with what the common pairs give (pair null), and one for each of its other pairs."""
        known, n, best = hot.value
        for batch in batches:
            held = [np.frombuffer(x, np.uint32) for x in batch["pairs"]]
            if not held:
                continue
            pairs, times = np.concatenate(held), np.concatenate([np.frombuffer(x, np.uint32) for x in batch["times"]]).astype(np.int64)
            own = np.repeat(np.arange(len(held)), [len(x) for x in held])
            place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
            rows = batch["row"].to_numpy(np.int64)
            sums = {name: _by(own[hit], times[hit] * x[place[hit]], len(rows)) for name, x in (("n_best", best), ("count_sum", n))}
            yield pd.DataFrame({"row": rows, "pair": pd.array([None] * len(rows), "Int64"), "times": 0} | sums)
            rest = ~hit
            if rest.any():
                other = pd.array(pairs[rest].astype(np.int64), "Int64")
                yield pd.DataFrame({"row": rows[own[rest]], "pair": other, "times": times[rest], "n_best": 0, "count_sum": 0})

    return run


def _by(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Integer sums by group (in order)."""
    total = np.concatenate([[0], np.cumsum(values)])
    edges = np.searchsorted(group, np.arange(n + 1))
    return total[edges[1:]] - total[edges[:-1]]


def align_documents(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose tokens do not join to the text with a space before it, have no tokens: zeros and ''.
    Repeated rows are documents of their own and count as such; null ids stay; other columns are not looked at; no rows give no rows.
    ``hot`` bounds the pairs whose counts every task gets; the result does not depend on it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    texts = scratch.save(rows.mapInPandas(_align(path_a, path_b), TEXTS), "texts")
    counts = texts.select("pairs").mapInPandas(_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    of_a = F.shiftright("pair", 16)
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))  # a row an id of A: at most 2 ** 16
    best = scratch.save(counts.join(F.broadcast(most), of_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "best")
    common = scratch.save(best.where(F.col("n") >= _threshold(best, hot)), "common")
    told = common.toPandas().sort_values("pair")  # at most ``hot`` rows
    arrays = spark.sparkContext.broadcast((told["pair"].to_numpy(np.uint32), told["n"].to_numpy(np.int64), told["best"].to_numpy(np.int64)))
    looked = texts.select("row", "pairs", "times").mapInPandas(_look_up(arrays), "row long, pair long, times long, n_best long, count_sum long")
    looked = scratch.save(looked, "looked")
    rare = looked.where("pair is not null").select("row", "pair", "times").join(best.join(common.select("pair"), "pair", "left_anti").hint("merge"), "pair")
    own = looked.where("pair is null").select("row", "n_best", "count_sum")
    both = own.unionByName(rare.select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")))
    sums = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kind = docs.schema["doc_id"].dataType
    return texts.drop("pairs", "times").join(sums.hint("merge"), "row").select(F.col("doc_id").cast(kind).alias("doc_id"), *COUNTS[:4], "n_best", "count_sum", "groups_sha256")


def _threshold(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` pairs reach: from how many pairs there are by the first 4 bits of their count."""
    bits = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    low = F.greatest(bits - 3, F.lit(0))
    rounded = F.expr("shiftleft(shiftright(n, _low), _low)")
    held = counts.withColumn("_low", low).groupBy(rounded.alias("least")).agg(F.count(F.lit(1)).alias("pairs")).collect()  # under 500 rows
    total, at = 0, 1 << 62
    for r in sorted(held, key=lambda r: -r["least"]):
        total += r["pairs"]
        if total > most:
            break
        at = r["least"]
    return at


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents, aligned between byte_bpe_50k (A) and piece_bpe_32k (B)."""
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), *paths())
