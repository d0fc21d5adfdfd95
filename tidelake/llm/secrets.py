"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions near hits, checksum validation.

One pass of an Aho-Corasick automaton over the text finds the places where a secret can begin. The
expressions are then matched at those places only. Long runs of hex digits begin with no keyword;
they are found by a run scan of their own. Tokens with a checksum inside count only if it holds.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from .shared import small_batches

#: The kinds in their order, keywords and expressions of the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "card")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD_WORDS = ("card", "visa", "mastercard", "ccnum")
CARD = re.compile(rb"[a-z]+(?:\x20(?:number|no\.?))?\x20*[:=#]\x20*([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])")
DIGITS62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SCAN = "struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string>"
LEAST = {"assign": 12, "access": 18}

_automaton = None


def _keywords():
    """Keyword automaton over lower-cased bytes, each byte one character; made once a worker."""
    global _automaton
    if _automaton is None:
        made = ahocorasick.Automaton()
        for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")), ("npm", ("npm_",)), ("card", CARD_WORDS)):
            for w in words:
                made.add_word(w, (kind, len(w)))
        made.make_automaton()
        _automaton = made
    return _automaton


def crc62(body: bytes, check: bytes) -> bool:
    """Whether ``check`` is the body's CRC-32 in six base-62 digits."""
    n, digits = zlib.crc32(body), []
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(DIGITS62[d])
    return bytes(reversed(digits)) == check


def luhn(digits: bytes) -> bool:
    """Whether the number's check digit holds."""
    total = 0
    for k, d in enumerate(reversed([c - 48 for c in digits])):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind. Null and empty texts have none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = raw.lower()
    found, after = [], dict.fromkeys(KINDS, 0)
    hits = [(end - n + 1, kind) for end, (kind, n) in _keywords().iter(low.decode("latin-1"))]
    for start, kind in sorted(set(hits)):
        if start < after[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(low, start):
                after[kind] = m.end()
                if len(m[1]) >= LEAST[kind]:
                    found.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(raw, start):
                after[kind] = m.end()
                if len(m[0]) >= LEAST[kind]:
                    found.append((start, m.end(), kind))
        elif kind in ("github", "npm"):
            m = (GITHUB if kind == "github" else NPM).match(raw, start)
            if m and crc62(m[1], m[2]):
                after[kind] = m.end()
                found.append((start, m.end(), kind))
        elif m := CARD.match(low, start):
            if luhn(m[1].replace(b" ", b"").replace(b"-", b"")):
                after[kind] = m.end()
                found.append((m.start(1), m.end(1), kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    found = sorted(set(found), key=lambda x: (x[0], KINDS.index(x[2])))
    if len(raw) == len(text or ""):
        return [(k, a, b) for a, b, k in found]
    points, at, n = {}, 0, 0
    for b in sorted({x for f in found for x in f[:2]}):
        n += len(raw[at:b].decode("utf-8", "surrogatepass"))
        at, points[b] = b, n
    return [(k, points[a], points[b]) for a, b, k in found]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for t in batch:
            spans = find_secrets(t if isinstance(t, str) else None)
            base = [s for s in spans if s[0] in KINDS[:3]]
            rows.append((*(sum(s[0] == k for s in base) for k in KINDS[:3]), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text with every secret replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    for batch in texts:
        out = []
        for t in batch:
            if isinstance(t, str) and (spans := find_secrets(t)):
                parts, at = [], 0
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        parts += [t[at:a], f"<{kind}>"]
                    at = max(at, b)
                t = "".join([*parts, t[at:]])
            out.append(t if isinstance(t, str) else None)
        yield pd.Series(out, dtype=object)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and what was found in its text: counts of the base kinds, their digest, and all spans.

    One row a document, equal rows and null ids included; null and empty texts have no secrets; no rows give no rows; other
    columns are not looked at, whatever their names. No shuffle; a very long text is one row's work.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", pandas_udf(_scan, SCAN)("text").alias("_s")).select("doc_id", "_s.*")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with secrets taken out of the text; null texts stay null, other columns as they are."""
    small_batches(docs.sparkSession)
    return docs.withColumn("text", pandas_udf(_redact, "string")("text"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
