"""Best-fit packing by bin completion.

Pieces of one length are interchangeable, so what is packed is the histogram of lengths: at most
``capacity`` counts, however many documents there are. Bin completion takes the largest length left,
enumerates the undominated fillings of the room beside it, applies each as often as the counts allow,
and prunes a branch whose waste shows that it cannot need fewer sequences than the incumbent. The
first incumbent is best-fit-decreasing, and each node that the search reaches offers a new one. Where the search
ends by its budget above the lower bound, small parts of the incumbent (its emptiest sequences with some others) are
searched again by the same method. The plan (patterns and how often each is used) is then laid over the numbered
pieces in tasks. ``least_sequences`` tells the proved least or the lower bound beside the plan, so that a gap shows.
"""

import bisect
import itertools
import random
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import Scratch, fresh, numbered

CAPACITY = 2048
#: A number of their own for pieces, by which equal ones are dealt as well.
PIECE = "_piece_row"
PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"

_tokenizers: dict = {}


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordwiseTokenizer:
    """Token ids of whole texts, by parts that the tokenizer never joins.

    word_bpe_49k splits at white space before anything else, and letters from a sign that follows them, so
    that a text's ids are those of its parts, one after another. Parts recur: the ids of the first
    ``keep`` ones are kept. A part of plain letters goes to the tokenizer's BPE model directly, lower-cased
    and in its byte letters; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters, model, encode = _byte_letters(), self.tokenizer.model, self.tokenizer.encode

        def plain(part: str) -> bool:
            return part.isalpha() and (part.isascii() or max(part) < "\u0250" and part.lower().isalpha())

        def ids_of(part: str) -> list[int]:
            if part.isalpha():
                if part.isascii():
                    return [t.id for t in model.tokenize(part.lower())]
                low = unicodedata.normalize("NFC", part).lower()
                if max(low) < "\u0250" and low.isalpha():  # beyond, lower-casing may differ
                    return [t.id for t in model.tokenize("".join([letters[b] for b in low.encode()]))]
            return encode(part, add_special_tokens=False).ids

        class Known(dict):
            def __missing__(self, part):
                if len(part) > 1 and part[-1] in ".,!?;:|" and plain(part[:-1]):
                    ids = self[part[:-1]] + self[part[-1]]
                else:
                    ids = array("I", ids_of(part)).tobytes()
                if len(self) < keep and len(part) <= 40:
                    self[part] = ids
                return ids

        self.known = Known()

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            parts = text.replace("\n", " ").replace("\t", " ").split(" ")
            yield np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")


def _tokenizer(path: str) -> WordwiseTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordwiseTokenizer(path)
    return _tokenizers[path]


def pieces_udf(path: str, end_id: int = 0, capacity: int = CAPACITY):
    """A column function: the pieces of a text (null: empty), each with start, length and the checksum of its ids."""

    @pandas_udf(PIECES)
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer, end = _tokenizer(path), np.array([end_id], "<u4")
        for batch in texts:
            out = []
            for ids in tokenizer(batch.fillna("").tolist()):
                ids = np.concatenate([ids, end])
                out.append([(k, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))])
            yield pd.Series(out)

    return pieces


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing over a histogram: (lengths in a sequence, how many sequences)."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # the keys of open_bins, in order
    closed: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                new = [((length,) * each, full)] * (full > 0) + [((length,) * rest, 1)] * (rest > 0)
                left = 0
            else:
                room = rooms[at]
                pattern, n = open_bins[room].popitem()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
                each = room // length
                full = min(n, left // each)
                new = [(pattern + (length,) * each, full)] * (full > 0)
                left -= full * each
                if full < n:
                    if left < each and left:
                        new.append((pattern + (length,) * left, 1))
                        left, full = 0, full + 1
                    if n > full:
                        new.append((pattern, n - full))
            for pattern, n in new:
                room = capacity - sum(pattern)
                if room:
                    if room not in open_bins:
                        bisect.insort(rooms, room)
                    same = open_bins.setdefault(room, {})
                    same[pattern] = same.get(pattern, 0) + n
                else:
                    closed.append((pattern, n))
    return closed + [(p, n) for at in open_bins.values() for p, n in at.items()]


def bound(counts: dict[int, int], capacity: int) -> int:
    """No packing needs fewer sequences: the largest of the Martello-Toth bounds over all thresholds."""
    if not counts:
        return 0
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    items, sizes = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * x))
    k = np.append(0, x[x <= capacity // 2])
    low, half, high = np.searchsorted(x, k), np.searchsorted(x, capacity // 2, "right"), np.searchsorted(x, capacity - k, "right")
    high = np.maximum(high, half)
    middle = items[high] - items[half]
    room = capacity * middle - (sizes[high] - sizes[half])
    rest = sizes[half] - sizes[np.minimum(low, half)] - room
    return int((items[-1] - items[half] + np.maximum(0, -(-rest // capacity))).max())


def fillings(room: int, counts: dict[int, int], limit: int) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated fillings of ``room``, least waste of all first, and whether there may be more than were returned.

    Undominated: no length left fits in the waste, and no item or pair of items of it can be exchanged for a single longer one
    that is left. At most ``limit`` are returned, of at most 40 times as many looked at.
    """
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    mask, sums = (1 << room + 1) - 1, [1]  # bit r of sums[k]: lengths[k:] have a filling of exactly r
    for x in reversed(lengths):
        here, copies, step = sums[-1], min(counts[x], room // x), 1
        while copies:
            step = min(step, copies)
            here |= here << step * x & mask
            copies, step = copies - step, 2 * step
        sums.append(here)
    sums.reverse()
    below = [-x for x in lengths]

    def exact(i: int, left: int, taken: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not left:
            yield taken
            return
        for k in range(max(i, bisect.bisect_left(below, -left)), len(lengths)):
            if not sums[k] >> left & 1:
                return
            x = lengths[k]
            for n in range(min(counts[x], left // x), 0, -1):
                if sums[k + 1] >> left - n * x & 1:
                    yield from exact(k + 1, left - n * x, taken + (x,) * n)

    def dominated(taken: tuple[int, ...], waste: int) -> bool:
        used = Counter(taken)
        several = [x for x, n in used.items() if n > 1]
        units = {0, *used, *(2 * x for x in several), *(x + y for x, y in itertools.combinations(used, 2))}
        free = lambda x: counts[x] > used[x]
        for u in units:  # a free length from u (itself only for a pair) to u + waste takes the place of u
            low = u if u and u not in used else u + 1
            k = bisect.bisect_left(below, -(u + waste))
            while k < len(lengths) and lengths[k] >= low:
                if free(lengths[k]):
                    return True
                k += 1
        return False

    found: list[tuple[int, ...]] = []
    looked = 0
    for waste in range(room + 1):
        for taken in exact(0, room - waste, ()) if sums[0] >> room - waste & 1 else ():
            if not dominated(taken, waste):
                found.append(taken)
            looked += 1
            if len(found) == limit or found and looked >= 40 * limit:
                return found, True
    return found, False


Plan = list[tuple[tuple[int, ...], int]]


def size(patterns: Plan) -> int:
    return sum(n for _, n in patterns)


def complete(counts: dict[int, int], capacity: int, nodes: int, width: int) -> tuple[Plan, bool]:
    """Bin completion: the best plan that the search finds, and whether it is proved that none is better.

    Ends when the incumbent meets the lower bound. ``width`` fillings a node are branched on at first. When all of these
    are searched and nodes are left, the search is made again with twice the width, until no node has a filling more: then the
    plan is the optimum. After ``nodes`` nodes in all no further branch is begun.
    """
    incumbent, least, seen = best_fit(counts, capacity), bound(counts, capacity), 0
    while size(incumbent) > least:
        if seen >= nodes:
            return incumbent, False
        incumbent, used, ended, cut = descend(counts, capacity, incumbent, least, nodes - seen, width)
        if size(incumbent) > least and not (ended and cut):
            return incumbent, ended
        seen, width = seen + used, 2 * width
    return incumbent, True


def descend(counts: dict[int, int], capacity: int, incumbent: Plan, least: int, nodes: int, width: int) -> tuple[Plan, int, bool, bool]:
    """One search, depth first: the incumbent, the nodes seen, whether no branch is left, and whether ``width`` cut fillings off.

    After ``nodes`` nodes the branch at hand is followed to its leaf, and each node on it uses up a length at least.
    """
    total = sum(k * n for k, n in counts.items())
    # a branch is held as its parent's counts and one filling, so that the stack has one table of counts a level
    stack, seen, depth, cut = [(counts, {}, 0, 0, None, 0)], 0, -1, False
    while stack and size(incumbent) > least:
        above, used, bins, waste, done, level = stack.pop()
        if seen >= nodes and level <= depth:
            return incumbent, seen, False, cut
        seen, depth = seen + 1, level
        if waste > (size(incumbent) - 1) * capacity - total:  # this branch cannot save a sequence
            continue
        left = {x: n - used.get(x, 0) for x, n in above.items() if n > used.get(x, 0)}
        rest = best_fit(left, capacity)
        if bins + size(rest) < size(incumbent):
            incumbent, at = rest, done
            while at:
                incumbent, at = [at[0], *incumbent], at[1]
        if not left or bins + bound(left, capacity) >= size(incumbent):
            continue
        largest = max(left)
        beside = left | {largest: left[largest] - 1}
        fills, more = fillings(capacity - largest, beside, width)
        cut = cut or more
        for fill in reversed(fills or [()]):
            taken = Counter((largest, *fill))
            times = min(left[x] // n for x, n in taken.items())
            # a filling is made as often as it can be, but also once, as the optimum may need it less often
            for often in sorted({1, times}):
                branch = {x: often * n for x, n in taken.items()}
                lost = waste + often * (capacity - largest - sum(fill))
                stack.append((left, branch, bins + often, lost, (((largest, *fill), often), done), level + 1))
    return incumbent, seen, not stack, cut


def repacked(patterns: Plan, capacity: int, least: int, tries: int, width: int, part: int = 10, nodes: int = 20) -> Plan:
    """The plan with parts of it searched again: the emptiest sequences, and others at random, ``part`` in all.

    A part is taken over if it needs fewer sequences, or as many with the room in fewer of them. Ends after
    ``tries`` parts in a row without a sequence less.
    """
    held, chance = Counter(), random.Random(17)
    for p, n in patterns:
        held[tuple(sorted(p, reverse=True))] += n
    filled = lambda ps: sum(sum(p) ** 2 * n for p, n in ps)
    failed = 0
    while failed < tries and held.total() > least:
        failed += 1
        room = sorted((sum(p), p) for p in held if sum(p) < capacity)[: 4 * part]
        chosen: Counter = Counter()
        for _, p in chance.sample(room, min(len(room), chance.randint(part // 3, part - 3))):
            chosen[p] += min(held[p], 2)
        others = list(held)
        for p in chance.choices(others, weights=[held[p] for p in others], k=3 * part):
            if chosen.total() < part and chosen[p] < held[p]:
                chosen[p] += 1
        lengths: Counter = Counter()
        for p, n in chosen.items():
            for x in p:
                lengths[x] += n
        found, _ = complete(dict(lengths), capacity, nodes, width)
        if (size(found), -filled(found)) < (chosen.total(), -filled(chosen.items())):
            failed = 0 if size(found) < chosen.total() else failed
            held -= chosen
            for p, n in found:
                held[tuple(sorted(p, reverse=True))] += n
    return list(held.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY, work: int = 200_000, width: int = 12, tries: int = 300) -> tuple[Plan, int]:
    """Patterns and their counts that use as few sequences as the search finds, and how many no packing can do without.

    ``work`` bounds the search: so many nodes times lengths, besides the branch at hand; ``tries`` the parts that are searched
    again where it did not prove its plan. Ends at once when the plan meets the lower bound. The second number is
    that bound, or the plan's own size where the search has proved it to be the optimum.
    """
    counts = {k: n for k, n in counts.items() if n}
    least = bound(counts, capacity)
    found, proved = complete(counts, capacity, 200 + work // max(1, len(counts)), width)
    if proved:
        return found, size(found)
    return repacked(found, capacity, least, tries, width), least


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length and first number: how many a sequence takes, its first sequence and offset."""
    taken: Counter = Counter()
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, group in itertools.groupby(sorted(pattern, reverse=True)):
            each = len(list(group))
            rows.append((length, taken[length], each, base, offset))
            taken[length] += each * times
            offset += each * length
        base += times
    rows.sort()
    table = np.array(rows or [(0, 0, 1, 0, 0)], dtype=np.int64)
    return {"key": (table[:, 0] << 48) + table[:, 1], "first": table[:, 1], "each": table[:, 2], "base": table[:, 3], "offset": table[:, 4]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id, offset and least_sequences to pieces (columns doc_id, piece, length, ids_crc32 and any others).

    ``pieces`` is read several times and should be a written table. No rows give no rows; equal rows
    are pieces of their own; null ids are kept; other columns come back as they are, whatever their names, unless they
    have one of the three. least_sequences is a number that no packing beats, the same in all rows: the number of
    sequences itself where the search has proved it, else the lower bound.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    patterns, needed = plan(counts, capacity)
    slots = spark.sparkContext.broadcast(_slots(patterns))  # bounded by ``capacity`` as well

    @pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        t, n, k = slots.value, number.to_numpy(np.int64), length.to_numpy(np.int64)
        at = np.searchsorted(t["key"], (k << 48) + n, side="right") - 1
        turn = n - t["first"][at]
        return pd.DataFrame({"sequence_id": t["base"][at] + turn // t["each"][at], "offset": t["offset"][at] + turn % t["each"][at] * k})

    order = [c for c in ("doc_id", "piece", "ids_crc32", "start", PIECE) if c in pieces.columns]
    number, at = fresh("number", pieces.columns), fresh("at", pieces.columns)
    placed = numbered(pieces, ["length"], order, number).withColumn(at, place("length", number))
    least = F.lit(needed).cast("long").alias("least_sequences")
    return placed.select(*pieces.columns, f"{at}.sequence_id", f"{at}.offset", least)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, least_sequences.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come. Other
    columns of ``docs`` are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    cut = docs.select("doc_id", F.explode(pieces_udf(tokenizer_path, end_id, capacity)("text")).alias("_p")).select("doc_id", "_p.*")
    return pack(scratch.save(cut.withColumn(PIECE, F.monotonically_increasing_id()), "pieces"), capacity).drop(PIECE)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe_path())
