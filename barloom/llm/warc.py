"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256. Record headers are stored
separately, byte for byte. Records are rebuilt by joining both tables, and every
rebuilt payload is checked against the digests before it is used.

Tables of an archive (`<path>/headers`, `<path>/payloads`, Parquet):
headers(record_id, header, payload_key), payloads(payload_key, payload).

Defined cases: a null payload is an empty one (0 bytes). Payloads under
`min_bytes` are always responses, stored once all the same. Of equal payloads
the record with the smallest id is the response. Repeated record ids: equal rows
each get a record; of these one is the response only if its id is the smallest,
so a repeated smallest id makes several responses. A null id sorts after all
others and its record is a response only if no other record has the payload.
A null url is written as an empty URI, line ends in one as %0A. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.scratch import cut, scratch_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Fixed, so that writing the same pages twice gives the same bytes.
WARC_DATE = "2024-01-01T00:00:00Z"


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 of a 160-bit digest in hex: four groups of 40 bits, eight characters each."""
    chars = []
    for group in range(4):
        value = F.conv(F.substring(hexed, 10 * group + 1, 10), 16, 10).cast("long")
        chars += [F.substring(F.lit(BASE32), (F.shiftright(value, 35 - 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*chars)


def payload_digest(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def records(pages: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """record_id, url, payload_key, payload_digest, payload_bytes, record_type, refers_to, first_id.

    Digests are worked out where the payload is read; only they and ids are exchanged.
    """
    raw = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    slim = pages.select(
        F.col(record_id).alias("record_id"), F.coalesce(F.regexp_replace(F.col(url), r"[\r\n]+", "%0A"), F.lit("")).alias("url"),
        F.sha2(raw, 256).alias("payload_key"), F.sha1(raw).alias("sha1_"), F.length(raw).cast("long").alias("payload_bytes"))
    slim = cut(slim, "payload-digests")
    first = slim.groupBy("payload_key").agg(F.min("record_id").alias("first_id"))
    response = (F.col("payload_bytes") < min_bytes) | F.col("record_id").eqNullSafe(F.col("first_id"))
    return slim.join(first, "payload_key").select(
        "record_id", "url", "payload_key", base32_of_hex(F.col("sha1_")).alias("payload_digest"), "payload_bytes",
        F.when(response, F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
        F.when(~response, F.col("first_id")).alias("refers_to"), "first_id",
    )


def urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(record_id.cast("string"), F.lit("null")), F.lit(">"))


def header_text(date: str = WARC_DATE) -> Column:
    """The exact header block of a record, ending with the empty line."""
    revisit = F.col("record_type") == "revisit"
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("record_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", urn(F.col("refers_to"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, record_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Write both tables: headers, one row per record, and payloads, one row per digest.

    Payload bytes move once, to find the rows whose record is a response. That
    join and the removal of repeated rows share one partitioning.
    """
    recs = records(pages, record_id, url, payload, min_bytes)
    recs.select("record_id", header_text().cast("binary").alias("header"), "payload_key").write.parquet(f"{path}/headers")
    ids = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    chosen = recs.select(ids(F.col("first_id")).alias("holder"), "payload_key").distinct()
    raw = pages.select(ids(F.col(record_id)).alias("holder"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    raw = raw.withColumn("payload_key", F.sha2("payload", 256))
    kept = raw.join(chosen, ["holder", "payload_key"], "left_semi").dropDuplicates(["holder", "payload_key"])
    kept.select("payload_key", "payload").write.parquet(f"{path}/payloads")


def header_field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\n{name}: ([^\r\n]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, rebuilt from both tables.

    record_id, record_type and refers_to come from the header (text of the ids; refers_to
    is null for responses); header and payload as stored; record: the exact bytes of
    the WARC record; payload_bytes and payload_digest of the stored payload, worked
    out again; verified: its bytes have the SHA-256 that they are stored under and
    the SHA-1 that the header states. What a reader does not select is not moved.
    """
    heads = spark.read.parquet(f"{path}/headers")
    store = spark.read.parquet(f"{path}/payloads").select(
        "payload_key", "payload", F.length("payload").cast("long").alias("payload_bytes"),
        payload_digest(F.col("payload")).alias("payload_digest"), (F.sha2("payload", 256) == F.col("payload_key")).alias("sound"),
    )
    out = heads.join(store, "payload_key", "left")
    number = lambda c: F.regexp_extract(c, r"^<urn:record:(.*)>$", 1)
    body = F.when(header_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return out.select(
        number(header_field("WARC-Record-ID")).alias("record_id"), header_field("WARC-Type").alias("record_type"),
        F.nullif(number(header_field("WARC-Refers-To")), F.lit("")).alias("refers_to"),
        "header", "payload", "payload_bytes", "payload_digest",
        F.concat(F.col("header"), body, F.lit((CRLF + CRLF).encode())).alias("record"),
        (F.coalesce(F.col("sound"), F.lit(False)) & (header_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")))).alias("verified"),
    )


def round_trip(pages: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archive to the shared folder and read its records back."""
    path = scratch_dir(pages.sparkSession, "warc")
    write_archive(pages, path, record_id, url, payload, min_bytes)
    return read_archive(pages.sparkSession, path)
