"""Content-addressed WARC archive.

An archive is two tables. ``payloads`` has each payload's bytes once, under their SHA-256 digest;
``records`` has every record's exact header text, and the digest of its payload. Reading joins the
two, recomputes the digest of every stored payload and fails where it differs.

All of it is DataFrame functions. A payload that a third of all records share is stored once (copies
are put together before they are shuffled); where its records meet it, they are dealt to cells, each of which
gets a copy of the payload (``shared.salted_join``).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, salted_join

#: The digits of RFC 4648 base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
END = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 40 bits are eight digits."""
    digits = []
    for group in range(4):
        value = F.conv(F.substring(F.sha1(data), 1 + 10 * group, 10), 16, 10).cast("long")
        for k in range(8):
            digits.append(F.substring(F.lit(BASE32), F.shiftright(value, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


def records_of(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """The records of pages (page_id, url, html): their payload's digests and length, and who responds.

    Of the records of one payload, that with the largest page_id is the response (of equal ids the
    last url, of equal rows the last copy); the others are revisits. Null html is an empty payload; a
    null id is less than any other. Other columns are not looked at, whatever their names; no rows give no rows.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").alias("id"), "url", F.sha2(payload, 256).alias("digest"), base32_sha1(payload).alias("sha1"),
        F.octet_length(payload).cast("long").alias("length"),
    )
    rows = rows.groupBy("id", "url", "digest", "sha1", "length").agg(F.count(F.lit(1)).alias("copies"))
    rows = scratch.save(rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies"), "rows")
    name = F.struct(F.col("id"), F.col("url"), F.col("copy"))
    # two digests and the length must agree for payloads to count as equal
    told = F.struct("sha1", "length")
    top = rows.groupBy("digest").agg(F.max(name).alias("top"), F.min(told).alias("low"), F.max(told).alias("high"), F.count(F.lit(1)).alias("n"))
    differ = F.raise_error(F.concat(F.lit("payloads differ under digest "), "digest"))
    top = top.select("digest", F.when(F.col("low") != F.col("high"), differ).otherwise(F.col("top")).alias("top"), "n")
    met = salted_join(rows, top, "digest", "n", rows.count(), ["id", "url", "copy"])
    return met.withColumn("responds", name.eqNullSafe(F.col("top")))


def header(date: str) -> Column:
    """The exact header of a record, up to and with the empty line.

    Line ends in a URL, which a header cannot hold, are percent-encoded.
    """

    def urn(of) -> Column:
        page, url = F.coalesce(of("id").cast("string"), F.lit("null")), F.substring(F.sha2(F.coalesce(of("url"), F.lit("")), 256), 1, 16)
        return F.concat(F.lit("<urn:page:"), page, F.lit(":"), url, F.lit(":"), of("copy").cast("string"), F.lit(">"))

    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))

    responds = F.col("responds")
    block = F.when(responds, F.col("digest")).otherwise(F.sha2(F.lit(""), 256))  # a revisit's block is empty
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    refers = F.concat(line("WARC-Refers-To", urn(lambda c: F.col(f"top.{c}"))), line("WARC-Profile", F.lit(PROFILE)))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(responds, "response").otherwise("revisit")),
        line("WARC-Record-ID", urn(F.col)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), block)),
        F.when(responds, "").otherwise(refers),
        F.lit(f"Content-Type: text/html; charset=UTF-8{CRLF}"),
        line("Content-Length", F.when(responds, F.col("length")).otherwise(0).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, scratch: Scratch, date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Write both tables and return them: records (header, digest), payloads (digest, payload, n: how many records have it)."""
    records = scratch.save(records_of(pages, scratch).select(header(date).alias("header"), "digest"), "records")
    scratch.drop("rows")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    each = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    once = each.groupBy("digest").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n"))
    return records, scratch.save(once, "payloads")


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every record again: header, digest and the payload, its own or that which it refers to."""
    damaged = F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("binary")
    kept = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(damaged)
    return salted_join(records, payloads.select("digest", kept.alias("payload"), "n"), "digest", "n", records.count(), ["header"])


def warc_bytes(read: DataFrame) -> DataFrame:
    """Add ``record``, the record as it stands in a WARC file: header, block (a revisit has none) and two line ends."""
    block = F.when(F.col("header").contains(f"{CRLF}WARC-Type: response{CRLF}"), F.col("payload")).otherwise(F.lit(b""))
    return read.withColumn("record", F.concat(F.encode("header", "UTF-8"), block, F.lit(END.encode())))


def parsed(written: DataFrame) -> DataFrame:
    """Take ``record`` apart: ``header`` and ``block`` are read from its bytes alone, and held against what the header says.

    Fails where the length, the end or the block's digest is not as told, or where a response's payload has another digest.
    """
    text = F.substring_index(F.col("record").cast("string"), END, 1)  # the first empty line ends the header
    begins = F.octet_length(text) + len(END)
    length = field("Content-Length").cast("int")
    rows = written.withColumn("header", F.concat(text, F.lit(END)))
    rows = rows.withColumn("block", F.substring(F.col("record"), begins + 1, length))
    whole = (F.octet_length("record") == F.octet_length("header") + length + len(END)) & F.col("record").endswith(F.lit(END.encode()))
    own = F.concat(F.lit("sha256:"), F.sha2("block", 256)) == field("WARC-Block-Digest")
    said = (field("WARC-Type") != "response") | (F.concat(F.lit("sha1:"), base32_sha1(F.col("block"))) == field("WARC-Payload-Digest"))
    broken = F.raise_error(F.concat(F.lit("damaged record "), F.coalesce(field("WARC-Record-ID"), F.lit("")))).cast("binary")
    return rows.withColumn("block", F.when(whole & own & said, F.col("block")).otherwise(broken))


def field(name: str) -> Column:
    """A header field's value; null where the header has none."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def archived(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """What the archive says of each page, once it is written and read back: one row a row of ``pages``.

    Every record is put together from header and payload, byte for byte, and taken apart again; all columns come from its bytes,
    a revisit's payload from the record that it refers to.
    """
    read = parsed(warc_bytes(read_archive(*write_archive(pages.select("page_id", "url", "html"), scratch))))
    payload = F.when(field("WARC-Type") == "response", F.col("block")).otherwise(F.when(F.octet_length("block") == 0, F.col("payload")))

    def page(name: str) -> Column:
        return F.expr(f"try_cast(regexp_extract(header, '\\r\\n{name}: <urn:page:([^:]*):', 1) as long)")

    return read.withColumn("whole", payload).select(
        page("WARC-Record-ID").alias("page_id"), F.octet_length("whole").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("whole")).alias("payload_digest"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        F.sha2("whole", 256).alias("payload_sha256"), field("WARC-Target-URI").alias("target_uri"),
    )


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to an archive and read back."""
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark))


#: DuckDB has no base-32 function: eight digits from each 40 bits, as above.
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * {g}, 10))::bigint >> {s}) & 31)::int, 1)"
OP1_SQL = f"""
with p as (select page_id, url, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
q as (select *, max(page_id) over (partition by payload) as top from p)
select page_id, strlen(payload)::bigint as payload_bytes,
       {" || ".join(_DIGIT.format(g=g, s=35 - 5 * k) for g in range(4) for k in range(8))} as payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id = top then null else top end as refers_to,
       sha256(payload) as payload_sha256, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') as target_uri
from q
"""
