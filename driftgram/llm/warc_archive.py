"""A content-addressed WARC archive (operator 13).

:func:`archive` writes two tables. ``payloads`` holds each distinct payload once, under its SHA-256;
``records`` holds a record's exact header (WARC fields and HTTP head, to the byte) and that digest.
Joining the two on the digest gives back every record as it would stand in a WARC file:
:func:`reconstruct` returns them, :func:`export` writes them as such files, and :func:`read` parses the
headers and measures the stored payloads.

A digest is trusted only where it is verified: all payloads that share one must agree in length and
SHA-1 too when they are stored, and the bytes are hashed again whenever the archive is read.

Of records with equal payloads, of ``min_bytes`` or more, those of the greatest page id are responses
and the others revisits of it; a smaller payload's records are all responses.

Edge cases: a null payload counts as empty; a null url leaves out the target field, line ends in a url
are percent-encoded; a null page id is less than any other, and where a payload has no other its
records are all responses; rows that repeat a page are each archived, and are of one type; an empty
table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: RFC 4648's base32 alphabet, and the profile of revisits of equal payloads.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

_PAYLOADS = "digest string, bytes long, sha1 string, response_id {id}, records long, payload binary"
_RECORDS = "page_id {id}, digest string, header string"


@dataclass(frozen=True)
class Archive:
    """Where an archive lies; ``id_type`` is the page id's type."""

    spark: SparkSession
    path: str
    id_type: str

    def payloads(self) -> DataFrame:
        return self.spark.read.schema(_PAYLOADS.format(id=self.id_type)).parquet(f"{self.path}/payloads")

    def records(self) -> DataFrame:
        return self.spark.read.schema(_RECORDS.format(id=self.id_type)).parquet(f"{self.path}/records")


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of binary data in base32: 32 characters of five bits, each within two hex digits."""

    def written(h: Column) -> Column:
        bits = lambda i: F.shiftright(F.conv(F.substring(h, 5 * i // 4 + 1, 2), 16, 10).cast("int"), 3 - 5 * i % 4).bitwiseAND(31)
        return F.concat(*(F.substring(F.lit(BASE32), bits(i) + 1, F.lit(1)) for i in range(32)))

    return common.let(F.sha1(data), written)


def _payload(pages: DataFrame) -> Column:
    return F.coalesce(pages["html"], F.lit("")).cast("binary")


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), digest).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _header(page_id: Column, url: Column, revisit: Column, date: str) -> Column:
    """The record's text up to its payload. A field whose value is null is left out."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    fields = {
        "WARC-Type": F.when(revisit, "revisit").otherwise("response"),
        "WARC-Record-ID": _record_id(page_id, F.col("digest")),
        "WARC-Date": F.lit(date),
        "WARC-Target-URI": F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("sha1")),
        "WARC-Profile": F.when(revisit, PROFILE),
        "WARC-Refers-To": F.when(revisit, _record_id(F.col("response_id"), F.col("digest"))),
        "X-Page-ID": page_id.cast("string"),
        "X-Refers-To-Page-ID": F.when(revisit, F.col("response_id").cast("string")),
        "Content-Type": F.lit("application/http; msgtype=response"),
        "Content-Length": length.cast("string"),
    }
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]  # null where the value is
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(END), http)


def archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Writes the archive of ``pages`` (page_id, url, html) below ``path``."""
    made = Archive(pages.sparkSession, path, dict(pages.dtypes)["page_id"])
    each = pages.select("page_id", _payload(pages).alias("payload")).select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("second"))
    one = each.groupBy("digest").agg(
        F.min("bytes").alias("bytes"), F.max("bytes").alias("most"), F.min("second").alias("second"), F.max("second").alias("last"),
        F.max("page_id").alias("response_id"), F.count("*").alias("records"), F.min("payload").alias("payload"),
    )
    differ = (F.col("bytes") != F.col("most")) | (F.col("second") != F.col("last"))
    checked = F.when(differ, F.raise_error(F.concat(F.lit("different payloads have the digest "), F.col("digest")))).otherwise(F.col("digest"))
    stored = one.select(checked.alias("digest"), "bytes", base32_sha1(F.col("payload")).alias("sha1"), "response_id", "records", "payload")
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    rows = pages.select("page_id", "url", F.sha2(_payload(pages), 256).alias("digest"))
    rows = common.with_groups(rows, made.payloads().select("digest", "bytes", "sha1", "response_id", "records"), "digest", "records")
    revisit = (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    rows.select("page_id", "digest", _header(F.col("page_id"), F.col("url"), revisit, date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")
    return made


def _verified(archived: Archive) -> DataFrame:
    """The stored payloads, hashed again: bytes and sha1 are measured, not read."""
    rows = archived.payloads()
    wrong = F.raise_error(F.concat(F.lit("the payload stored under this digest isn't its own: "), F.col("digest")))
    digest = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(wrong)
    return rows.select(digest.alias("digest"), "payload", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"), "records")


def _field(name: str) -> Column:
    """A WARC field's value; null where the record lacks it."""
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def read(archived: Archive) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id) of every record, from the archive alone."""
    rows = common.with_groups(archived.records().select("digest", "header"), _verified(archived).drop("payload"), "digest", "records")
    said = F.concat(F.lit("sha1:"), F.col("sha1"))
    held = F.when(_field("WARC-Payload-Digest") == said, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("a header names another payload than "), said)))
    of_page = lambda name: _field(name).cast(archived.id_type)
    return rows.select(
        of_page("X-Page-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"), F.col("bytes").alias("payload_bytes"), held.alias("payload_digest"),
        _field("WARC-Type").alias("record_type"), of_page("X-Refers-To-Page-ID").alias("refers_to"), _field("WARC-Record-ID").alias("record_id"),
    )


def reconstruct(archived: Archive) -> DataFrame:
    """(page_id, header, payload, block): the page's payload, and the record's own block after the WARC fields.

    A revisit's block is its HTTP head alone; its payload comes from the record that it refers to.
    """
    rows = common.with_groups(archived.records(), _verified(archived).select("digest", "payload", "records"), "digest", "records")
    revisit = _field("WARC-Type") == "revisit"
    head = F.substring_index("header", END, -2)
    return rows.select("page_id", "header", "payload", F.when(revisit, head.cast("binary")).otherwise(F.concat(head.cast("binary"), F.col("payload"))).alias("block"))


def export(archived: Archive, path: str) -> None:
    """WARC files, gzipped, one a task: records one after another, each ended by two line ends."""
    rows = reconstruct(archived)
    whole = F.concat(F.substring_index("header", END, 1), F.lit(END), F.col("block").cast("string"))
    rows.select(whole.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def query(spark, sf_dir: str) -> DataFrame:
    made = archive(common.table(spark, sf_dir, "pages"), common.new_path(spark, "warc"))
    return read(made).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = "strpos('0123456789abcdef', substr(h, {}, 1)) - 1"
_BITS = " || ".join(f"substr('{BASE32}', ((((({_DIGITS.format(5 * i // 4 + 1)}) * 16 + {_DIGITS.format(5 * i // 4 + 2)}) >> {3 - 5 * i % 4}) & 31) + 1)::INTEGER, 1)" for i in range(32))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT t, max(page_id) AS response FROM p GROUP BY t)
SELECT page_id, strlen(p.t)::BIGINT AS payload_bytes, {_BITS} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM p JOIN m ON p.t = m.t
"""
