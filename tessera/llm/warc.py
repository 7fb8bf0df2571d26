"""A content-addressed web archive.

Payload bytes are stored once under their SHA-256 digest, which an independent
SHA-1 and the length verify; record headers are stored separately, byte for byte
as WARC/1.1 writes them, with the digest. Reading joins the two and rebuilds the
original records.

Of records with equal payloads of at least `least` bytes, the one with the
largest id is the response and the others revisit it; smaller ones are responses.

Equal payloads meet by digest after a partial aggregation, so a payload that
fills a third of the rows crosses the network once for each task that read it;
headers find their digest's facts with heavy digests broadcast (their number is
bounded) and the rest shuffled. To rebuild records, payload bytes go to the headers'
tasks: a payload that many records share is copied for each thousandth of all records
that it has, so its records are spread and no payload is broadcast.

Defined results: null html is an empty payload; a null url is written as an empty
target; a url with line breaks has them escaped in the target and is kept whole, in
base64, in a field of its own; payloads of any length are one value each; a row with a null page_id is a record of its own, never the response for
others if one of them has an id, and among rows with equal payloads and null ids
only all are responses; repeated rows with the largest id are all responses; an
empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import lookup_join, salted_join, shared_folder

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"
#: The field that keeps a url which a header line can't hold as it is.
WHOLE_URL = "X-Target-URI-Base64"


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """Write folder/payloads (digest, payload) and folder/headers (digest, header)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    stored = rows.groupBy("digest").agg(
        F.max_by("payload", F.lit(1)).alias("payload"),
        F.min(F.sha1("payload")).alias("sha1"),
        F.max(F.sha1("payload")).alias("other_sha1"),
        F.min(F.length("payload")).alias("bytes"),
        F.max(F.length("payload")).alias("other_bytes"),
        F.max("page_id").alias("owner"),
        F.count("*").alias("n"),
    )
    same = (F.col("sha1") == F.col("other_sha1")) & (F.col("bytes") == F.col("other_bytes"))
    checked = F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256 digest")).cast("binary"))
    stored.select("digest", checked.alias("payload"), "sha1", F.col("bytes").cast("long"), "owner", "n").write.option("compression", "zstd").parquet(f"{folder}/payloads")

    spark = pages.sparkSession
    facts = spark.read.parquet(f"{folder}/payloads").select("digest", "sha1", "bytes", "owner", "n")
    counts, total = facts.select("digest", "n"), facts.agg(F.sum("n")).first()[0] or 0
    found = lookup_join(rows.select("page_id", "url", "digest"), facts.drop("n"), "digest", counts, total)
    revisit = (F.col("bytes") >= least) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    no_break = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    whole = F.when(no_break != F.col("url"), line(WHOLE_URL, F.base64(F.col("url").cast("binary")))).otherwise(F.lit(""))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", no_break),
        whole,
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Refers-To", record_id(F.col("owner")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(END),
    )
    found.select("digest", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def field(header: Column, name: str) -> Column:
    """A named field's value, or null."""
    value = F.regexp_extract(header, rf"\r\n{re.escape(name)}: ([^\r]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"{END}{name}: ")), value)


def page_of(record: Column) -> Column:
    return F.regexp_extract(record, "^<urn:page:(.*)>$", 1).try_cast("long")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload, n), each payload verified against its address."""
    stored = spark.read.parquet(f"{folder}/payloads").select("digest", "payload", "n")
    right = F.sha2("payload", 256) == F.col("digest")
    return stored.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged")).cast("binary")))


def rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """(record, payload) of each record: its bytes, revisits without a block, and the stored payload it stands for."""
    stored = payloads(spark, folder)
    counts = spark.read.parquet(f"{folder}/payloads").select("digest", "n")
    heads = spark.read.parquet(f"{folder}/headers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    joined = salted_join(heads, stored.drop("n"), "digest", counts, total, F.xxhash64("header"))
    block = F.when(field(F.col("header").cast("string"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return joined.select(F.concat("header", block, F.lit(END + END).cast("binary")).alias("record"), "payload")


def head_of(record: Column) -> Column:
    """A record's header as text, with its last line's end."""
    return F.concat(F.substring_index(record.cast("string"), END + END, 1), F.lit(END))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record): the bytes of each record, revisits without their payload."""
    return rebuilt(spark, folder).select(page_of(field(head_of(F.col("record")), "WARC-Record-ID")).alias("page_id"), "record")


def restored(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload) of every record, revisits included."""
    found = rebuilt(spark, folder).select(head_of(F.col("record")).alias("head"), "payload")
    url = F.coalesce(F.unbase64(field(F.col("head"), WHOLE_URL)).cast("string"), field(F.col("head"), "WARC-Target-URI"))
    return found.select(page_of(field(F.col("head"), "WARC-Record-ID")).alias("page_id"), url.alias("url"), "payload")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """What a read of the archive finds in each rebuilt record: id, type, and facts of the payload bytes."""
    found = rebuilt(spark, folder).select(head_of(F.col("record")).alias("head"), F.length("record").alias("size"), "payload")
    value = lambda name: field(F.col("head"), name)
    agree = (value("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.sha1("payload"))) & (F.col("size") == F.octet_length("head") + value("Content-Length").cast("int") + 6)
    digest = F.when(agree, F.sha1("payload")).otherwise(F.raise_error(F.lit("a header and its payload disagree")))
    return found.select(
        page_of(value("WARC-Record-ID")).alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        value("WARC-Type").alias("record_type"),
        page_of(value("WARC-Refers-To")).alias("refers_to"),
    )


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages to a new archive in the shared folder, rebuild its records and list them."""
    folder = shared_folder(pages.sparkSession)
    write(pages, folder, least)
    return listing(pages.sparkSession, folder)
