"""SpotSigs document fingerprints, by DataFrame functions alone.

A spot is an occurrence of one of the corpus's most common words, an anchor. Its signature is the anchor and the
chain of the content words (words that are no anchors) that follow it. A text's fingerprint is the set
of its signatures. Sets are compared by Jaccard likeness, and only with sets whose size lets them be
alike enough: sizes are cut into partitions so that two sets further apart than neighbours cannot be.
"""

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import set_join
from .set_join import likeness
from .shared import Scratch, components, text_of

ANCHORS, CHAIN = 48, 2
#: Parts are found among so many cuts, and again so many within each; their number has that square as its bound.
FAN = 512


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal(text: Column) -> Column:
    """Lower-cased words with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def common_words(docs: DataFrame, n: int = ANCHORS) -> list[str]:
    """The ``n`` most frequent words of all texts, ties by the word."""
    words = docs.select(F.explode(F.split(normal(text_of()), " ")).alias("word")).where("word <> ''")
    return [r["word"] for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(n).collect()]


def signatures(text: Column, anchors: list[str], chain: int = CHAIN) -> Column:
    """The sorted set of spot signatures, as 64-bit hashes.

    A unit is a content word with the anchors before it; the chain of each of its anchors is that
    word and those of the next ``chain`` - 1 units (fewer at the end). A text without a spot, an
    empty one too, has its whole normal form as its only signature, so that no set is empty.
    """
    alternatives = "|".join(re.escape(a) for a in sorted(anchors, key=lambda a: (-len(a), a)))
    pattern = rf"(?:(?:{alternatives}) )*+[^ ]+" if anchors else r"[^ ]+"

    def spots(us: Column, u: Column, k: Column) -> Column:
        content = [F.substring_index(u, " ", -1)] + [F.coalesce(F.substring_index(F.get(us, k + d), " ", -1), F.lit("")) for d in range(1, chain)]
        return let(F.array(*content), lambda c: F.transform(F.slice(F.split(u, " "), 1, F.regexp_count(u, F.lit(" "))), lambda a: F.xxhash64(a, c)))

    def of_units(us: Column) -> Column:
        found = F.flatten(F.filter(F.transform(us, lambda u, k: F.when(F.instr(u, " ") > 0, spots(us, u, k))), lambda s: s.isNotNull()))
        return F.array_sort(F.array_distinct(found))

    def of_words(words: Column) -> Column:
        found = let(F.regexp_extract_all(words, F.lit(pattern), F.lit(0)), of_units)
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.xxhash64(words))))

    return let(normal(text), of_words)


def digest(signs: Column) -> Column:
    """A fingerprint's name: the number of signatures and a digest of the sorted set."""
    return F.concat(F.size(signs).cast("string"), F.lit(":"), F.md5(F.array_join(F.transform(signs, lambda s: F.hex(s)), "")))


def with_next(docs: DataFrame, make: dict[str, callable], rows_per_part: int = 2_000) -> DataFrame:
    """doc_id, text, the columns of ``make`` (from text), and for each its value in the next document, ``next_<name>``.

    Next is by descending doc_id (null last; of equal ids by text), after the last comes the first. The
    documents are cut by id into parts of about ``rows_per_part``; each part also gets the first
    document of the part after it, so that one shuffle of the texts does and no task has them all.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", text_of().alias("text"))
    parts = max(1, min(-(-base.count() // rows_per_part), FAN * FAN))
    found = base.approxQuantile("doc_id", [k / parts for k in range(1, parts)], max(1e-5, 0.1 / parts)) if parts > 1 else []
    cuts = sorted({int(c) for c in found if c is not None}, reverse=True)
    # the part of an id is how many cuts lie above it: found by halving among every ``each``-th cut, then counted
    each = -(-max(1, len(cuts)) // FAN)
    coarse = [cuts[min(k + each, len(cuts)) - 1] for k in range(0, len(cuts), each)]

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("doc_id") >= coarse[middle], halve(low, middle)).otherwise(halve(middle + 1, high))

    part = halve(0, len(coarse))
    if each > 1:
        block = [cuts[k : k + each] for k in range(0, len(cuts), each)] + [[]]
        lists = F.lit(block) if len(cuts) else F.array(F.array())
        part = let(part, lambda g: g * each + F.size(F.filter(F.get(lists, g), lambda c: c > F.col("doc_id"))))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(coarse) * each)).otherwise(part)
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.sha2("text", 256).alias("tie"))
    keyed = base.withColumn("part", part)
    heads = {r["part"]: (r["head"]["doc_id"], r["head"]["tie"]) for r in keyed.groupBy("part").agg(F.max(order).alias("head")).collect()}
    there = sorted(heads)
    before = {p: there[k - 1] for k, p in enumerate(there)}  # the part that ends where this one begins; the first follows the last
    lead = spark.createDataFrame([(p, *heads[p], before[p]) for p in there], "part int, head_id long, head_tie string, other int")
    marked = keyed.join(F.broadcast(lead), "part")  # one row a part
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.sha2("text", 256) == F.col("head_tie"))
    own, guest = F.struct(F.col("part"), F.lit(0).alias("guest")), F.struct(F.col("other").alias("part"), F.lit(1).alias("guest"))
    dealt = marked.select("doc_id", "text", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("at")).select("at.part", "at.guest", "doc_id", "text")
    made = dealt.repartition(max(1, len(there)), "part").withColumn("tie", F.sha2("text", 256))
    for name, f in make.items():
        made = made.withColumn(name, f(F.col("text")))
    w = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.desc("tie"))
    for name in ("text", *make):
        made = made.withColumn(f"next_{name}", F.lead(name).over(w))
    return made.where("guest = 0").drop("part", "guest", "tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the edited text's digest, both fingerprints, their signatures, and the likenesses that the contract asks for.

    A fingerprint is named by its size and digest; its signatures, from which the likenesses follow, stand beside it. Null
    texts count as empty. Equal ids and repeated rows each keep their row and are neighbours. A single
    document is its own next one. No rows give no rows. Other columns are not looked at, whatever their names.
    """
    anchors = common_words(docs)
    signs = functools.partial(signatures, anchors=anchors)
    rows = with_next(docs, {"signs": signs})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_signs", signs(F.col("edited")))
    own, changed, after = F.col("signs"), F.col("edited_signs"), F.col("next_signs")
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digest(own).alias("fingerprint"),
        digest(changed).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, after).alias("near_next"),
        own.alias("signatures"), changed.alias("edited_signatures"),
    )


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and class_id: documents that chains of fingerprints of likeness ``least`` or more connect.

    Equal fingerprints are put together first; the others are joined by size partitions and pruned likeness
    (set_join). class_id is the least doc_id of the class. Null texts count as empty, and texts without words are one class; null
    ids name a class only if it has no other; repeated rows stay; no rows give no rows; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    anchors = common_words(docs)
    rows = scratch.save(docs.select("doc_id", signatures(text_of(), anchors).alias("signs")).withColumn("name", digest(F.col("signs"))), "rows")
    sets = scratch.save(rows.groupBy("name").agg(F.first("signs").alias("signs"), F.min("doc_id").alias("least")).withColumn("node", F.xxhash64("name")), "sets")
    links = scratch.save(set_join.links(sets, least, scratch), "links")
    roots = scratch.save(sets.select("name", "node", "least").join(components(links, scratch), "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("name", "class_id")
    return rows.select("doc_id", "name").join(named, "name").select("doc_id", "class_id")


def op5_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how alike they are."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
