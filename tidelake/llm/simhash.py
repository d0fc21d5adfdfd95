"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are kept in binary tries. A pair of nodes is traversed together, the bits in which the
two prefixes differ are accumulated, and the pair is given up as soon as they are more than the
error budget. Two fingerprints within d bits share at least one of d + 1 bit blocks, so the join
starts, for each rotation that brings a block to the front, below the nodes of that block, where
no bit of the budget is spent. On Spark a row stands for a fingerprint under a node pair: pairs with
too many fingerprints go down further bits together, in rounds; the others are finished in tasks.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import set_join
from .shared import ODD, Scratch, WordHashes, components, crowd_join, mix, text_of

#: For each byte value its eight bits.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - shingle + 1)
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(joined)]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts[:n], stops, strict=True)), np.uint64, n)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    by_byte = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(h))))


def shingles(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """Hashes of the word shingles, repeats included; fewer words than ``size`` are one shingle, none have none."""
    word = known.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    size = min(size, len(word))
    h = np.zeros(len(word) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        h = h * ODD[0] + mix(word[k : k + len(h)])
    return mix(h)


def band_keys(distinct: np.ndarray, bands: int = 16, rows: int = 6) -> np.ndarray:
    """Keys of a set of shingle hashes (distinct, in order), of which sets of likeness 0.8 have an equal one in 99 of 100 cases.

    The range of hashes is cut into ``bands`` * ``rows`` bins; a bin stands for its least hash, an empty one for that of the
    next bin that has any. Two sets agree in a bin with a chance of their likeness. A key is made of ``rows`` bins that lie
    far apart, whatever the size of the set, so that it takes several shingles in common to agree in it.
    """
    if not len(distinct):
        return np.empty(0, np.uint64)
    bins = bands * rows
    edges = (np.arange(bins, dtype=np.uint64) * np.uint64((1 << 64) // bins)).astype(np.uint64)
    least = distinct[np.searchsorted(distinct, edges) % len(distinct)].reshape(rows, bands)
    keys = np.arange(bands, dtype=np.uint64)
    for row in least:
        keys = mix(keys * ODD[0] + row * ODD[1])
    return keys


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint's 64 bits as a signed long; null texts have no words."""
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t if isinstance(t, str) else None) for t in batch], np.uint64).astype(np.int64))


def _links_below(left: np.ndarray, right: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``budget`` bits, of sorted fingerprints below two trie nodes (right None: one node)."""
    out_a, out_b = [], []

    def visit(a0: int, a1: int, b0: int, b1: int, bit: int, differ: int, same: bool) -> None:
        if a0 == a1 or b0 == b1 or same and a1 - a0 < 2:
            return
        other = left if right is None else right
        if (a1 - a0) * (b1 - b0) <= 1024 or bit < 0:
            i, j = np.nonzero(np.bitwise_count(left[a0:a1, None] ^ other[None, b0:b1]) <= budget)
            keep = i + a0 < j + b0 if same else slice(None)
            out_a.append(i[keep] + a0)
            out_b.append(j[keep] + b0)
            return
        half = lambda v, lo, hi: lo + int(np.searchsorted((v[lo:hi] >> np.uint64(bit)) & np.uint64(1), 1))
        a, b = half(left, a0, a1), half(other, b0, b1)
        visit(a0, a, b0, b, bit - 1, differ, same)
        visit(a, a1, b, b1, bit - 1, differ, same)
        if differ < budget:  # the nodes part here: one more differing bit
            visit(a0, a, b, b1, bit - 1, differ + 1, False)
            if not same:
                visit(a, a1, b0, b, bit - 1, differ + 1, False)

    if right is None:
        visit(0, len(left), 0, len(left), 63, 0, True)
    else:
        visit(0, len(left), 0, len(right), 63, 0, False)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links connect: at most n - 1."""
    up, kept = list(range(n)), []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = x, y
        while up[rx] != rx:
            up[rx] = up[up[rx]]
            rx = up[rx]
        while up[ry] != ry:
            up[ry] = up[up[ry]]
            ry = up[ry]
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def _finish(budget: int):
    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Node pairs arrive sorted; one that a batch's end cuts waits for the next batch."""
        rest = None

        def solve(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            keys = part[["node", "differs", "depth", "turn"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(part)]
            bits, sides = part["bits"].to_numpy(np.int64).view(np.uint64), part["side"].to_numpy()
            original, found = part["fp"].to_numpy(np.int64), []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo < 2:
                    continue
                order = lo + np.lexsort((bits[lo:hi], sides[lo:hi]))
                n_left = int((sides[lo:hi] == 0).sum())
                v = bits[order]
                if keys[lo][1] == 0:
                    a, b = _links_below(v, None, budget)
                else:
                    a, b = _links_below(v[:n_left], v[n_left:], budget)
                    b = b + n_left
                found += [(original[order[x]], original[order[y]]) for x, y in _forest(hi - lo, a, b)]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rest[["node", "differs", "depth", "turn"]].to_numpy()
            last = (keys == keys[-1]).all(axis=1)
            cut = len(rest) - int(last.sum())
            yield from solve(rest.iloc[:cut].reset_index(drop=True))
            rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None:
            yield from solve(rest)

    return finish


def _keyed(rows: DataFrame) -> DataFrame:
    """node: the lesser of the two prefixes that differ in ``differs``; side: 0 below it, 1 below the other."""
    prefix = F.expr("shiftrightunsigned(bits, cast(64 - depth as int))")
    other = prefix.bitwiseXOR(F.col("differs"))
    return rows.withColumn("node", F.least(prefix, other)).withColumn("side", (prefix > other).cast("int"))


def trie_links(fingerprints: DataFrame, scratch: Scratch, budget: int = 2, crowd: int = 256, step: int = 4) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp), enough to connect all within ``budget`` bits.

    A node pair with more than ``crowd`` fingerprints is not given to a task: its rows go ``step`` bits
    down, each to the child pairs whose differing bits stay within the budget.
    """
    edges = [64 * k // (budget + 1) for k in range(budget + 2)]
    turns = F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(edges[k]).alias("by"), F.lit(edges[k + 1] - edges[k]).alias("depth")) for k in range(budget + 1)]))
    rows = fingerprints.select("fp", turns.alias("_t")).select("fp", "_t.turn", "_t.depth", F.expr("case when _t.by = 0 then fp else shiftleft(fp, _t.by) | shiftrightunsigned(fp, 64 - _t.by) end").alias("bits"), F.lit(0).cast("long").alias("differs"))
    pair = ["turn", "depth", "node", "differs"]
    masks = F.array(*[F.lit(m) for m in range(1 << step) if m.bit_count() <= budget])
    ready, round_ = None, 0
    rows = scratch.save(_keyed(rows), "pairs-0")
    while True:
        counts = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n"), F.sum("side").alias("_right"))
        live = counts.where("_n > 1 and (differs = 0 or (_right > 0 and _right < _n))")
        kept = scratch.save(rows.join(live, pair), f"live-{round_}")
        scratch.drop(f"pairs-{round_}")
        few = kept.where(F.col("_n") <= crowd).select(*pair, "side", "bits", "fp")
        ready = few if ready is None else ready.unionByName(few)
        many = kept.where(F.col("_n") > crowd)
        if not many.limit(1).count():
            break
        round_ += 1
        down = many.select("fp", "turn", "bits", "depth", "differs", F.explode(masks).alias("_m")).where(F.bit_count("differs") + F.bit_count("_m") <= budget)
        down = down.select("fp", "turn", "bits", (F.col("depth") + step).alias("depth"), F.shiftleft("differs", step).bitwiseOR(F.col("_m").cast("long")).alias("differs"))
        rows = scratch.save(_keyed(down), f"pairs-{round_}")
    dealt = ready.repartition(*pair).sortWithinPartitions(*pair)
    return dealt.mapInPandas(_finish(budget), "a long, b long").distinct()


def near_duplicates(fps: DataFrame, budget: int = 2) -> DataFrame:
    """(fp, root) for each distinct fingerprint of ``fps`` (column fp): fingerprints of one component share root."""
    scratch = Scratch(fps.sparkSession)
    distinct = scratch.save(fps.select("fp").distinct(), "distinct")
    links = scratch.save(trie_links(distinct, scratch, budget), "links")
    roots = components(links, scratch)
    return distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, budget: int = 2) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id among the documents that chains of fingerprints within
    ``budget`` bits reach; null ids count only if there is no other. Texts without words, empty and
    null ones included, have fingerprint 0 and are linked like any other. Equal rows stay; no rows give no rows;
    other columns are not looked at, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.save(docs.select("doc_id", pandas_udf(_fingerprints, "long")("text").alias("fp")), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    roots = scratch.save(near_duplicates(fps, budget).join(least, "fp"), "roots")
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "copies")
    # all texts without words have one fingerprint
    return crowd_join(fps, named, "fp", "copies", fps.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _keys(size: int):
    def keys(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in texts:
            rows = []
            for t in batch:
                h = shingles(t, size, known)
                rows.append((np.uint64(majority(h) if len(h) else 0).astype(np.int64), band_keys(np.unique(h)).view(np.int64)))
            yield pd.DataFrame(rows, columns=["fp", "bands"])

    return pandas_udf(keys, "struct<fp:long,bands:array<long>>")


def _signs(size: int):
    def signs(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordHashes()
        for batch in texts:
            yield pd.Series([np.unique(shingles(t, size, known)).view(np.int64) for t in batch])

    return pandas_udf(signs, "array<long>")


#: Texts that all meet each other in a task, and how many of their shingles it holds at once.
BLOCK, BLOCK_SIGNS = 256, 4_000_000


def alike_in_block(signs: list[np.ndarray], roots: list[int], least: float, columns: int = 4_096) -> list[tuple[int, int]]:
    """Index pairs of sets of the likeness ``least``, enough to connect all such pairs, beside what ``roots`` connect already."""
    owner = np.repeat(np.arange(len(signs)), [len(s) for s in signs])
    every, place, n = np.unique(np.concatenate(signs), return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1  # signs of one text only have no part in what texts share
    of_many = n[place] > 1
    owner, place = owner[of_many], shared[place[of_many]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(signs), len(signs)), np.float32)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        lo, hi = np.searchsorted(place, [start, start + columns])
        held = np.zeros((len(signs), columns), np.float32)
        held[owner[lo:hi], place[lo:hi] - start] = 1
        common += held @ held.T
    size = np.array([len(s) for s in signs])
    i, j = np.nonzero(np.triu(common >= least * (size[:, None] + size[None, :] - common), 1))
    same: dict[int, int] = {}
    known = [(same.setdefault(r, k), k) for k, r in enumerate(roots)]
    known = [(a, b) for a, b in known if a != b]
    joined = _forest(len(signs), np.array([a for a, _ in known] + i.tolist()), np.array([b for _, b in known] + j.tolist()))
    return joined[len(known) :]


def _in_blocks(least: float, most: int | None = BLOCK_SIGNS):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks arrive sorted; one with more than ``most`` shingles is done in parts, without it as a whole."""
        now, nodes, roots, signs, size = None, [], [], [], 0

        def out() -> Iterator[pd.DataFrame]:
            if len(set(roots)) > 1:
                found = alike_in_block(signs, roots, least)
                if found:
                    yield pd.DataFrame([(nodes[a], nodes[b]) for a, b in found], columns=["a", "b"])

        for batch in batches:
            for band, block, root, node, own in zip(*(batch[c] for c in ("band", "block", "root", "node", "signs")), strict=True):
                if (band, block) != now or most is not None and size > most:
                    yield from out()
                    now, nodes, roots, signs, size = (band, block), [], [], [], 0
                nodes.append(node)
                roots.append(root)
                signs.append(np.asarray(own, np.int64))
                size += len(signs[-1])
        yield from out()

    return run


def _pairs(cells: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of different components that share ``key``; a key has a bounded number of rows (key, node, root)."""
    left, right = (cells.select(key, F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    return left.join(right, key).where("root_a < root_b").select("a", "b")


def _tiles(left: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """band, block, root, node: every two texts of a band that are in different components share a block. left: band, node, root.

    The texts of a band's largest component, and its others, are cut into blocks of about BLOCK texts and a quarter of BLOCK_SIGNS. Each block
    of others meets all blocks, so that work grows with the largest component as long as the others are few.
    """
    mixed = left.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    sized = left.join(mixed, "band").join(sets.select("node", F.size("signs").alias("size")), "node").select("band", "node", "root", "size")
    sized = scratch.save(sized, "mixed")
    of_root = sized.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    largest = of_root.groupBy("band").agg(
        F.max(F.struct("n", "root", "s")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s")
    )
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / (BLOCK_SIGNS // 4)), F.lit(1))
    cuts = largest.select(
        "band", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.s")).alias("mains"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("others")
    )
    cell = F.xxhash64("band", "node", F.lit(1))
    in_main = F.col("root") == F.col("main")
    placed = sized.join(cuts, "band").withColumn("own", F.pmod(cell, F.when(in_main, F.col("mains")).otherwise(F.col("others"))))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # a tile is a block of the others and a later one of them, or (from the number of these on) a block of the largest component
    with_others = F.transform(every("others"), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")))
    with_mains = F.transform(every("mains"), lambda k: F.struct(F.col("own").alias("i"), (F.col("others") + k).alias("j")))
    of_main = F.transform(every("others"), lambda k: F.struct(k.alias("i"), (F.col("others") + F.col("own")).alias("j")))
    return placed.select("band", "root", "node", F.explode(F.when(in_main, of_main).otherwise(F.concat(with_others, with_mains))).alias("block"))


def alike_texts(texts: DataFrame, least: float, size: int, scratch: Scratch, budget: int = 2, few: int = 16) -> DataFrame:
    """Links (a, b) among the distinct texts (node, text): pairs whose sets of ``size``-word shingles have the Jaccard
    likeness ``least``, and enough of them to connect the groups of such texts.

    Near copies by that measure differ in about ten bits of a whole text's fingerprint, more than a trie can be pruned
    by. So the trie join of whole fingerprints is helped by keys from the least hashes of the shingles (band_keys); every
    candidate is verified. All texts of a key meet the key's first one. Where that leaves different components, up to ``few``
    texts of a key meet each other, and the texts of larger keys are dealt to blocks of about BLOCK by a hash of text and key, within
    which all meet. Where a key is then still in several components, every two of its texts in different ones meet (_tiles). So
    no pair that shares a key is missed, and work grows with the texts as long as most of a key's texts are one component by then; a key of many
    texts that are not alike costs the square of their number, in tiles of two blocks. What can be missed: a pair that shares no
    key, one in a hundred at the likeness 0.8.
    """
    made = scratch.save(texts.withColumn("_k", _keys(size)("text")).select("node", F.col("_k.fp").alias("fp"), F.col("_k.bands").alias("bands")), "keys")
    first = made.groupBy("fp").agg(F.min("node").alias("node"))
    by_trie = scratch.save(trie_links(first.select("fp"), scratch, budget), "trie")
    ends = [first.select(F.col("fp").alias(x), F.col("node").alias(f"{x}_node")) for x in "ab"]
    by_trie = by_trie.join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same_fp = made.join(first.withColumnRenamed("node", "a"), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    keyed = made.select("node", F.explode("bands").alias("band"))
    crowds = keyed.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = scratch.save(keyed.join(crowds, "band"), "cells")
    to_first = cells.where("node <> a").select("a", F.col("node").alias("b"))
    pairs = scratch.save(to_first.unionByName(by_trie).unionByName(same_fp).distinct(), "candidates")
    named = cells.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    chosen = texts.join(named.hint("merge"), "node", "left_semi")  # one plan at every size
    sets = scratch.save(chosen.select("node", _signs(size)("text").alias("signs")), "sets")
    star = scratch.save(set_join.alike(pairs, sets, least), "star")
    roots = scratch.save(components(star, scratch, "star"), "star-roots")
    placed = scratch.save(cells.select("band", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    left = scratch.save(placed.join(mixed, "band"), "left")
    met = _pairs(left.where(F.col("n") <= few), "band").distinct()
    crowd = left.where(F.col("n") > few).withColumn("block", F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / BLOCK)))
    blocks = crowd.join(sets.hint("merge"), "node").select("band", "block", "root", "node", "signs")
    blocks = blocks.repartition("band", "block").sortWithinPartitions("band", "block")
    in_blocks = scratch.save(blocks.mapInPandas(_in_blocks(least), "a long, b long"), "in-blocks").distinct()
    found = star.unionByName(set_join.alike(scratch.save(met, "met"), sets, least)).unionByName(in_blocks)
    if not crowd.limit(1).count():
        return found
    found = scratch.save(found, "found")
    roots = scratch.save(components(found, scratch, "found"), "found-roots")
    rest = crowd.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    tiles = _tiles(rest, sets, scratch).join(sets.hint("merge"), "node").select("band", "block", "root", "node", "signs")
    tiles = tiles.repartition("band", "block").sortWithinPartitions("band", "block")
    tiled = scratch.save(tiles.mapInPandas(_in_blocks(least, None), "a long, b long"), "in-tiles").distinct()
    return found.unionByName(tiled)


def keep_one(docs: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id (null last), of equal ones the first read.

    Near copies are equal texts and texts whose sets of ``size``-word shingles have the Jaccard likeness ``least`` or more, in
    chains. Texts without words (null and empty ones) are one group. All columns of ``docs`` come back unchanged, under
    whatever names; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, doc = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    digest = F.unhex(F.sha2(text_of(text), 256))
    saved = scratch.save(rows.withColumn("digest", digest).withColumn("row", F.monotonically_increasing_id()), "rows")
    first = F.min(F.struct(F.col(doc).isNull(), F.col(doc).alias("doc"), F.col("row"))).alias("first")
    texts = saved.groupBy("digest").agg(first, F.first(text_of(text)).alias("text")).withColumn("node", F.col("first.row"))
    texts = scratch.save(texts.select("node", "first", "text"), "texts")
    once = scratch.save(texts.select("node", "first"), "once")
    links = scratch.save(alike_texts(texts.select("node", "text"), least, size, scratch), "links")
    scratch.drop(*[name for name in list(scratch.paths) if name not in ("rows", "once", "links")])  # nothing reads them any more
    roots = once.join(components(links, scratch), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = roots.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return saved.join(kept.hint("merge"), "row", "left_semi").select(*rows.columns).toDF(*names)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents with their SimHash fingerprints and components."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
