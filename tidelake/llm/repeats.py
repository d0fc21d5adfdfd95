"""Removal of byte strings that documents repeat, by sorted suffix tuples.

Full suffix arrays are not built (README.md, "Suffix-array dedup"). What is kept of external induced
sorting: only sampled suffixes are sorted, by Spark's external sort; equal neighbours pass what they have in
common on; and the order of the samples induces the answer for all positions between them.

A sample is a position whose next GRAM bytes have the least hash among those that begin in some stretch
of LENGTH - GRAM + 1 positions, so that every string of LENGTH bytes contains one, at a place that the string
alone decides. That sample owns the string. The steps:

1. Equal texts are put together; only the one with the least id goes on.
2. Sample tuples (hash, text, position) are sorted; those with an equal neighbour recur.
3. A recurring sample's owned strings are one run of bytes. Runs that are equal as wholes are settled at
   once: all strings of a run are repeats in every document but the first that has it.
4. Where a sample recurs in different runs, the strings of each of those runs in the first document are compared one by
   one. What is found at a run's first place in a document holds for its other places there.
5. The strings found are merged to spans in their texts.

Texts lie in cells of neighbouring rows, tuples go to buckets, ranges of their hash: a shuffled row is the bytes of
the tuples that go from one cell or frame to one bucket, and back. A bucket keeps one tuple of each hash (those of one
doc_id, where equal ids share a string) and passes the others on as they come, so that no hash fills a task.
Equality is of 96 bits of hashes or more.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ODD, Scratch, bucket_of, cell_of, crowd_join, dealt, mix, row_number, text_of

LENGTH, GRAM = 50, 32
CHUNK, LOW = 1 << 19, np.uint64((1 << 20) - 1)
LAST = (1 << 63) - 1
#: Texts are dealt to cells of 2 ** CELL_BITS rows; one over LONG bytes is a cell by itself.
CELL_BITS, LONG = 8, 1 << 18
LOW_ROW = (1 << CELL_BITS) - 1
#: Bytes of text whose samples (one in about ten) make a bucket.
BUCKET_BYTES = 20_000_000


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes."""
    n = len(data) - 7
    words = mix(np.ndarray((n,), "<u8", data, 0, (1,)) * ODD[0] + ODD[1])
    n = len(data) - GRAM + 1
    total = words[:n] * ODD[0]
    for k in range(1, GRAM // 8):
        total = total + words[8 * k : 8 * k + n] * ODD[k]
    return mix(total)


def stretches(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """The texts in groups of about CHUNK bytes, as (number of the text, offset in it, bytes); long texts go in
    pieces that overlap by LENGTH - 1, texts under LENGTH bytes are left out."""
    held, size = [], 0
    for k, data in enumerate(texts):
        for begin in range(0, len(data) - LENGTH + 1, CHUNK):
            piece = data[begin : begin + CHUNK + LENGTH - 1]
            if held and size + len(piece) > CHUNK:
                yield held
                held, size = [], 0
            held.append((k, begin, piece))
            size += len(piece)
    if held:
        yield held


def owned_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """The samples of the texts, some texts at a time. Of each sample: number of its text, hash, position, first and
    last + 1 owned string (in its text), hash of that run, and where its strings begin in the last array, the hashes of strings."""
    window = LENGTH - GRAM + 1
    for pieces in stretches(texts):
        part = b"".join(p for _, _, p in pieces)
        h = gram_hashes(part)
        least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)  # ties: the first
        size = 1
        while 2 * size <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if window > size:
            least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
        # only strings that lie in one piece count; the sample that owns one lies in the same piece
        lengths = np.array([len(p) for _, _, p in pieces])
        starts = lengths - (LENGTH - 1)
        shift = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(pieces)), starts)
        start = np.arange(len(of)) + np.repeat(shift - (np.cumsum(starts) - starts), starts)
        owner = (least[start] & LOW).astype(np.int64)
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        end = np.append(begin[1:], len(owner))
        at, first, last = owner[begin], start[begin], start[end - 1] + 1
        strings = mix(h[start] * ODD[1] + h[start + LENGTH - GRAM] * ODD[2])
        runs = mix(strings[begin] * ODD[3] + strings[end - 1] * ODD[0] + (last - first).astype(np.uint64) * ODD[4] + (at - first).astype(np.uint64) * ODD[5])
        text, offset = np.array([k for k, _, _ in pieces])[of[begin]], (np.array([o for _, o, _ in pieces]) - shift)[of[begin]]
        yield text, h[at], at + offset, first + offset, last + offset, runs, begin, strings


def encoded(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _frames(parts: Iterator[tuple], most: int = 400_000) -> Iterator[list[np.ndarray]]:
    """Tuples of arrays, put together to about ``most`` rows."""
    held, rows = [], 0
    for p in parts:
        held.append(p)
        rows += len(p[0])
        if rows >= most:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, rows = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _samples(buckets: int):
    """Sample tuples, dealt to ``buckets`` ranges of the hash; a row has a frame's tuples of one range as bytes."""

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts():
            for batch in batches:
                rows = batch["row"].to_numpy(np.int64)
                for text, h, at, *_ in owned_runs(encoded(batch["text"])):
                    yield h, rows[text], at

        for frame in _frames(parts()):
            h, row, at = _known_here(*frame)
            h = mix(h)  # samples are least of many hashes: mixed anew, they lie evenly
            # within a bucket 32 bits tell hashes apart well enough: a chance match costs work, no wrong result
            yield dealt("bucket", bucket_of(h, buckets), {"h": h.astype(np.uint32), "row": row, "at": at})

    return samples


def _known_here(h: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mark tuples whose hash recurs among these, by a negative position; all but the first of them get a key of their own.

    Those are known to recur and need not meet the others, so that a passage that a third of all
    documents share sends one tuple a frame to its key, and the rest anywhere.
    """
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    later = np.zeros(len(h), bool)
    later[order] = np.append(False, same)
    known = later.copy()
    known[order] |= np.append(same, False)
    own = mix(row.view(np.uint64) * ODD[0] + at.view(np.uint64) * ODD[1])
    return np.where(later, own, h), row, np.where(known, -1 - at, at).astype(np.int32)


def _by_bucket(batches: Iterator[pd.DataFrame], kinds: dict[str, str], most: int = 4_000_000) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """The tuples of sorted buckets as arrays: at most about ``most`` at once, and whether the bucket ends with them."""
    bucket, held, rows = None, [], 0

    def arrays() -> dict[str, np.ndarray]:
        return {c: np.concatenate([np.frombuffer(x[k], t) for x in held]) for k, (c, t) in enumerate(kinds.items())}

    for batch in batches:
        for b, *x in zip(batch["bucket"].tolist(), *[batch[c] for c in kinds], strict=True):
            if held and (b != bucket or rows >= most):
                yield arrays(), b != bucket
                held, rows = [], 0
            bucket = b
            held.append(x)
            rows += len(x[0]) // np.dtype(next(iter(kinds.values()))).itemsize
    if held:
        yield arrays(), True


def _joined(kept: dict[str, np.ndarray] | None, new: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([kept[c], new[c]]) for c in new} if kept else new


def _differs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first one does."""
    n = len(columns[0])
    out = np.ones(n, bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _head(new: np.ndarray) -> np.ndarray:
    """For each row the first one of its group; ``new`` marks those."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _recurring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sample tuples that recur, by the cell of their text. Memory follows the distinct hashes of a bucket: one tuple of each waits."""
    kept = None
    for t, ends in _by_bucket(batches, {"h": "u4", "row": "i8", "at": "i4"}):
        t = _joined(kept, t | {"done": np.zeros(len(t["h"]), bool)})
        order = np.argsort(t["h"], kind="stable")
        t = {c: v[order] for c, v in t.items()}
        new = _differs(t["h"])
        again = ~new | np.append(~new[1:], False) | (t["at"] < 0)
        out = again & ~t["done"]
        row, at = t["row"][out], t["at"][out]
        yield dealt("cell", row >> CELL_BITS, {"low": (row & LOW_ROW).astype(np.uint8), "x": np.where(at < 0, -1 - at, at)})
        kept = None if ends else {c: v[new] for c, v in (t | {"done": again | t["done"]}).items()}


def _places(texts: pd.DataFrame, found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The texts' row numbers, and of what was found in the cell the number of its text and the values."""
    rows = texts["row"].to_numpy(np.int64)
    number = np.zeros(LOW_ROW + 1, np.int64)
    number[rows & LOW_ROW] = np.arange(len(rows))
    values = {c: np.frombuffer(b"".join(found[c]), np.int32) for c in ("x", "y", "z") if c in found}
    return rows, number[np.frombuffer(b"".join(found["low"]), np.uint8)], values


def _chosen(wanted: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places (text, at) are among the sorted ``wanted`` ones."""
    here = (text.astype(np.int64) << 32) | at
    return np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, here), len(wanted) - 1)] == here)


def _in_cell(bits, columns: dict[str, str], take):
    """A function for a cell's texts and what was found in them: the tuples that ``take`` makes, dealt to buckets."""

    def made(key: tuple, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(texts):
            return pd.DataFrame({c: [] for c in ("bucket", *columns)}).astype({"bucket": "int32"})
        rows, of, values = _places(texts, found)
        wanted, order = np.sort((of << 32) | values["x"]), texts["ord"].to_numpy(np.int64)
        out = [x for x in (take(wanted, rows, order, owned) for owned in owned_runs(encoded(texts["text"]))) if x is not None]
        parts = {c: np.concatenate([x[c] for x in out]).astype(t) if out else np.empty(0, t) for c, t in columns.items()}
        return dealt("bucket", bucket_of(mix(parts[bits[0]].view(np.uint64)), bits[1]), parts)

    return made


RUNS = {"h": "u8", "run": "u8", "ord": "i8", "row": "i8", "first": "i4", "n": "u1"}
STRINGS = {"string": "u8", "h": "u4", "ord": "i8", "row": "i8", "at": "i4"}


def _take_runs(wanted, rows, order, owned):
    """Of recurring samples their runs."""
    text, h, at, first, last, runs, *_ = owned
    k = _chosen(wanted, text, at)
    return {"h": h[k], "run": runs[k], "ord": order[text[k]], "row": rows[text[k]], "first": first[k], "n": last[k] - first[k]} if len(k) else None


def _take_strings(wanted, rows, order, owned):
    """The strings of the runs that begin at wanted places."""
    text, h, _, first, last, _, begin, strings = owned
    k = _chosen(wanted, text, first)
    if not len(k):
        return None
    n = last[k] - first[k]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return {"string": strings[np.repeat(begin[k], n) + step], "h": np.repeat(h[k], n), "ord": np.repeat(order[text[k]], n), "row": np.repeat(rows[text[k]], n), "at": np.repeat(first[k], n) + step}


FOUND = "cell long, kind string, low binary, x binary, y binary, z binary"


def _by_cell(kind: str, row: np.ndarray, *values: np.ndarray) -> pd.DataFrame:
    columns = {"low": (row & LOW_ROW).astype(np.uint8)} | {c: np.asarray(v, np.int32) for c, v in zip("xyz", values, strict=False)}
    frame = dealt("cell", row >> CELL_BITS, columns).assign(kind=kind)
    return frame.reindex(columns=["cell", "kind", "low", "x", "y", "z"]).astype({c: object for c in "xyz"}).where(lambda f: f.notna(), b"")


def _settled_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is known of whole runs: ``whole`` ones go, begin x to end y; the strings of ``open`` ones (x) must be compared, since their
    sample recurs in another run; of ``twin`` ones (x, y) goes what goes of the same document's run at z."""
    kept = None
    for t, ends in _by_bucket(batches, RUNS):
        t = _joined(kept, t)
        order = np.lexsort((t["ord"], t["run"], t["h"]))
        t = {c: v[order] for c, v in t.items()}
        head = _head(_differs(t["h"], t["run"]))
        gone = t["ord"] > t["ord"][head]
        if gone.any():
            yield _by_cell("whole", t["row"][gone], t["first"][gone], t["first"][gone] + t["n"][gone])
        t = {c: v[~gone] for c, v in t.items()}
        if not ends:
            kept = t
            continue
        kept = None
        new_h, new_run = _differs(t["h"]), _differs(t["h"], t["run"])
        several = (np.add.reduceat(new_run, np.flatnonzero(new_h)) > 1)[np.cumsum(new_h) - 1]
        new_row = _differs(t["h"], t["run"], t["row"])  # a document's places of a run arrive in one piece
        head = _head(new_row)
        for kind, at in (("open", several & new_row), ("twin", several & ~new_row)):
            if at.any():
                yield _by_cell(kind, t["row"][at], t["first"][at], t["first"][at] + t["n"][at], t["first"][head[at]])


def _settled_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The places (x) of strings that a smaller doc_id has. Of each string those of the least doc_id so far wait."""
    kept = None
    for t, ends in _by_bucket(batches, STRINGS):
        t = _joined(kept, t)
        order = np.lexsort((t["ord"], t["h"], t["string"]))
        t = {c: v[order] for c, v in t.items()}
        gone = t["ord"] > t["ord"][_head(_differs(t["h"], t["string"]))]
        if gone.any():
            yield _by_cell("single", t["row"][gone], t["at"][gone])
        kept = None if ends else {c: v[~gone] for c, v in t.items()}


def _starts(found: pd.DataFrame, of: np.ndarray, v: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the intervals of places where strings to remove begin, text << 32 | place, in order and apart."""
    kind = np.repeat(found["kind"].to_numpy(), [len(x) for x in found["low"]])
    # each column has values only in the rows whose kind has them, so that they are laid out by kind
    has = {c: np.repeat([len(x) > 0 for x in found[c]], [len(x) for x in found["low"]]) for c in "yz"}
    full = {"x": v["x"].astype(np.int64)} | {c: np.zeros(len(kind), np.int64) for c in "yz"}
    for c in "yz":
        full[c][has[c]] = v[c]
    base = of << 32
    runs, twins = np.isin(kind, ("whole", "single")), kind == "twin"
    begin = (base + full["x"])[runs]
    end = np.where(kind == "single", base + full["x"] + 1, base + full["y"])[runs]
    begin, end = _apart(begin, end)
    if twins.any() and len(begin):
        n = (full["y"] - full["x"])[twins]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        like, own = np.repeat((base + full["z"])[twins], n) + step, np.repeat((base + full["x"])[twins], n) + step
        k = np.searchsorted(begin, like, side="right") - 1
        gone = own[(k >= 0) & (like < end[np.maximum(k, 0)])]
        begin, end = _apart(np.append(begin, gone), np.append(end, gone + 1))
    return begin, end


def _apart(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, touching ones made one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])
    return begin[new], reach[np.append(np.flatnonzero(new)[1:], len(new)) - 1]


CUT = "digest binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _cut(key: tuple, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The results of the texts of a cell that lose something."""
    out = []
    if len(texts) and len(found):
        rows, of, values = _places(texts, found)
        begin, end = _starts(found, of, values)
        begin, end = _apart(begin, end + LENGTH - 1)
        for k in np.unique(begin >> 32).tolist():
            a, b = np.searchsorted(begin, [k << 32, (k + 1) << 32]).tolist()
            spans = list(zip((begin[a:b] - (k << 32)).tolist(), (end[a:b] - (k << 32)).tolist(), strict=True))
            data = texts["text"].iat[k].encode("utf-8", "surrogatepass")
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = hashlib.sha256(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            out.append((texts["digest"].iat[k], sum(y - x for x, y in spans), len(spans), kept.hexdigest(), spans))
    return pd.DataFrame(out, columns=["digest", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end in bytes) of each document.

    A byte goes if a string of LENGTH bytes that covers it also begins in a document with a smaller doc_id.
    Null ids count as larger than any other and as equal to each other; documents with equal ids do not take from one
    another. Null and short texts lose nothing. Every row of ``docs`` gives one row; other columns are not looked at,
    whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    order = F.coalesce("doc_id", F.lit(LAST))
    rows = docs.select("doc_id", order.alias("ord"), text_of().alias("text"))
    size = F.octet_length("text").cast("long")
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    keys = scratch.save(rows.select("doc_id", "ord", size.alias("n_bytes"), digest), "keys")
    once = rows.where(size >= LENGTH).groupBy(digest).agg(F.min("ord").alias("ord"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = scratch.save(once.withColumn("row", row_number(F.octet_length("text"), CELL_BITS, LONG)), "texts")

    total = keys.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_BYTES))
    def sorted_by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition("bucket").sortWithinPartitions("bucket")

    def binaries(columns) -> str:
        return ", ".join(f"{c} binary" for c in columns)

    cells = texts.withColumn("cell", cell_of("row", CELL_BITS)).groupBy("cell")
    # each step's tables go as soon as nothing reads them, since they and the shuffles share the disk
    tuples = texts.select("row", "text").mapInPandas(_samples(buckets), f"bucket int, {binaries(('h', 'row', 'at'))}")
    again = scratch.save(sorted_by_bucket(tuples).mapInPandas(_recurring, "cell long, low binary, x binary"), "recurring")
    runs = cells.cogroup(again.groupBy("cell")).applyInPandas(_in_cell(("h", buckets), RUNS, _take_runs), f"bucket int, {binaries(RUNS)}")
    known = scratch.save(sorted_by_bucket(runs).mapInPandas(_settled_runs, FOUND), "known")
    scratch.drop("recurring")
    opened = known.where("kind = 'open'").select("cell", "low", "x")
    strings = cells.cogroup(opened.groupBy("cell")).applyInPandas(_in_cell(("string", buckets), STRINGS, _take_strings), f"bucket int, {binaries(STRINGS)}")
    single = scratch.save(sorted_by_bucket(strings).mapInPandas(_settled_strings, FOUND), "single")
    gone = known.where("kind <> 'open'").unionByName(single)
    cut = scratch.save(cells.cogroup(gone.groupBy("cell")).applyInPandas(_cut, CUT), "cut")
    scratch.drop("known", "single")
    found = texts.select("digest", F.col("ord").alias("first_ord"), "copies").join(cut, "digest", "left")
    copy, whole_digest = F.col("ord") > F.col("first_ord"), F.lower(F.hex("digest"))
    own = lambda c, none: F.coalesce(F.col(c), none)
    joined = crowd_join(keys, found, "digest", "copies", keys.count())
    return joined.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(own("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(own("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(own("kept_sha256", whole_digest)).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(own("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
    )


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes that earlier ones have."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


#: Bytes are two hex digits each, so that strings of them can be cut at any byte.
OP7_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
c as (select doc_id, begin, least(256, n - 49 - begin) as starts, substr(h, 2 * begin + 1, 610) as piece from (select doc_id, h, n, unnest(range(0, greatest(0, n - 49), 256)) as begin from d)),
w as (select doc_id, begin + k as s, md5_number(substr(piece, 2 * k + 1, 100)) as g from (select doc_id, begin, piece, unnest(range(starts)) as k from c)),
m as (select g, min(doc_id) as first_doc from w group by g),
dup as (select w.doc_id, w.s from w join m using (g) where m.first_doc < w.doc_id),
marked as (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 50 then 0 else 1 end as fresh from dup),
numbered as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as run from marked),
runs as (select doc_id, run, min(s) as a, max(s) + 50 as b from numbered group by doc_id, run),
before as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as kept_from from runs),
cut as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' order by a) || substr(max(h), 2 * max(b) + 1) as kept
        from before join d using (doc_id) group by doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join cut using (doc_id)
"""
