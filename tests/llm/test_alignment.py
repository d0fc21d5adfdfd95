"""Cross-tokenizer alignment against a plain version, token by token."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest

from tidelake.llm import alignment

NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    return alignment.tokenizers(*alignment.paths())


def plain(rows, both):
    """The contract, with the tokenizers' own encoders."""
    a, b = both
    out, links = [], []
    for doc, text in rows:
        x = y = []
        if text:
            raw = (" " + text).encode()
            x, y = a.own.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
            if b"".join(a.bytes[i] for i in x) != raw or b"".join(b.bytes[i] for i in y) != raw:
                x = y = []
        if not x:
            out.append([doc, 0, 0, 0, 0, 0, 0, ""])
            links.append([])
            continue
        spans = []
        for ids, table in ((x, a.bytes), (y, b.bytes)):
            stops = list(itertools.accumulate(len(table[i]) for i in ids))
            spans.append(list(zip([0, *stops], stops)))
        shared = sorted({s for _, s in spans[0]} & {s for _, s in spans[1]})
        groups = [
            "|".join(",".join(str(i) for i, (p, q) in zip(ids, own) if lo < q <= hi) for ids, own in ((x, spans[0]), (y, spans[1])))
            for lo, hi in zip([0, *shared], shared)
        ]
        links.append([(i, j) for i, (p, q) in zip(x, spans[0]) for j, (r, s) in zip(y, spans[1]) if p < s and r < q])
        out.append([doc, len(x), len(y), len(shared), len(links[-1]), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest()])
    count = Counter(pair for own in links for pair in set(own))
    most = {}
    for (i, _), n in count.items():
        most[i] = max(n, most.get(i, 0))
    for row, own in zip(out, links):
        row[5] = sum(count[p] == most[p[0]] for p in own)
        row[6] = sum(count[p] for p in own)
    return sorted(map(tuple, out), key=str)


TEXTS = [
    (1, "The unbelievable lamps, re-lit: it's 12345.67!"), (2, "The unbelievable lamps"), (3, None), (4, ""), (5, " "), (6, "  two  spaces \n\n\ttabs "), (7, "中文 ロボット 😀👩‍👩‍👧 ﷺ ǅ"),
    (8, "a▁b"), (9, "<|endoftext|> <s> </s> <unk> <0x41>"), (10, "x" * 3000), (11, "ÉÀß ñandú œuvre"), (12, "  　end"), (13, "ﬁne ½ Ⅷ é"), (14, "\x00\x07 control"),
    (1, "The unbelievable lamps, re-lit: it's 12345.67!"), (None, "lamps"), (None, None), (10**15 + 1, "don't we'll I'm they've"),
]


@pytest.mark.parametrize("hot", [0, 20, alignment.HOT])
def test_alignment(spark, both, hot):
    docs = spark.createDataFrame([(i, t, 1, "r", b"p") for i, t in TEXTS], "doc_id long, text string, pair int, row string, pairs binary").repartition(3)
    got = alignment.align_documents(docs, *alignment.paths(), hot=hot)
    assert sorted((tuple(r[n] for n in NAMES) for r in got.collect()), key=str) == plain(TEXTS, both)
    assert alignment.align_documents(docs.limit(0), *alignment.paths()).collect() == []


def test_alignment_of_the_table(spark, sf_dir, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows if len(t or "") < 1500]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = alignment.align_documents(docs, *alignment.paths(), hot=500).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=str) == plain(rows, both)
    assert alignment.op12_alignment(spark, sf_dir).where("n_a > 0").count() > 100


def test_cuts_by_halves():
    """Any two lists of ends, also without a cut in a long interval."""
    r = np.random.default_rng(1)
    for n, share in ((1, 1), (50, 0.5), (400, 0.02), (400, 0.0)):
        for _ in range(20):
            a, b = (np.unique(np.append(r.integers(1, 2000, n) * 2 + side * (r.random(n) > share), 9999)) for side in (0, 1))
            at_a, at_b = alignment.cuts(a, b, np.array([len(a) - 1]), np.array([len(b) - 1]))
            assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_encoders_agree(both):
    """The faster encoder and the file's own give the same ids."""
    a = both[0]
    assert a.fast
    r = np.random.default_rng(7)
    letters = [chr(c) for c in range(0x250) if not 0xD800 <= c < 0xE000] + list(" '.,\n\t" * 20)
    texts = [" " + "".join(r.choice(letters, 200)) for _ in range(300)]
    assert a.encode(texts) == [a.own.encode(t, add_special_tokens=False).ids for t in texts]
