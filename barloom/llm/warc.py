"""Content-addressed WARC archive: payload bytes once by digest, exact record headers beside them, records by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import cut

END = "\r\n"
#: Records of one payload that meet it in one part.
PART_RECORDS = 1000


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def _field(header: Column, name: str, pattern: str = r"[^\r]*") -> Column:
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ({pattern})\r\n", 1), F.lit(""))


def _dealt(records: DataFrame) -> DataFrame:
    """records (with digest and _row) with part: those of one payload are dealt over parts of about PART_RECORDS."""
    counted = records.groupBy("digest").agg(F.ceil(F.count(F.lit(1)) / PART_RECORDS).cast("int").alias("parts"))
    salted = records.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(PART_RECORDS)))
    met = salted.select("digest", "_salt").distinct().join(counted, "digest")
    return salted.join(met, ["digest", "_salt"]).withColumn("part", F.pmod(F.xxhash64("_row", F.lit(1)), F.col("parts")).cast("int")).drop("_salt", "parts")


class Archive:
    """Two Parquet tables in a folder: payloads (digest, parts, payload), headers (digest, part, bare, own, header: the exact header block).

    A payload is stored once. Records of one that has very many are dealt over `parts`, so their join is split too. A
    bare record has its payload's digest but no payload in its block (a revisit). own: written by write().
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _store(self, rows: DataFrame) -> None:
        """Payloads of rows (digest, payload), which meet as one per digest and task; equal SHA-256 are checked by a second digest and the length."""
        check = F.concat_ws(":", F.sha1("payload"), F.octet_length("payload"))
        parts = F.ceil(F.count(F.lit(1)) / PART_RECORDS).cast("int")
        stored = rows.withColumn("check", check).groupBy("digest").agg(F.first("payload").alias("payload"), F.min("check").alias("check"), F.max("check").alias("_other"), parts.alias("parts"))
        same = F.when(F.col("check") == F.col("_other"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one SHA-256")).cast("binary"))
        stored.select("digest", "parts", same.alias("payload")).write.option("compression", "zstd").parquet(f"{self.path}/payloads")

    def write(self, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = 1000) -> None:
        """Write a record per row of pages, into a new folder; the payload is html in UTF-8.

        Of records with equal payloads of at least revisit_bytes, that with the largest page_id is a response and the
        others revisit it; smaller ones are all responses. Null html is an empty payload, a null url an empty target.
        A null page_id is below all others; if a payload has no other, its records are all responses. Rows that repeat
        a page_id and payload are records of their own and of the same type. Line ends in urls are percent-encoded.
        """
        payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
        rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
        self._store(rows.select("digest", "payload"))
        slim = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"), F.monotonically_increasing_id().alias("_row"))
        slim = cut(slim, "records")
        first = slim.groupBy("digest").agg(F.max("page_id").alias("first_id"))
        salted = slim.withColumn("_deal", F.pmod(F.xxhash64("_row", F.lit(2)), F.lit(PART_RECORDS)))
        met = salted.select("digest", "_deal").distinct().join(first, "digest")
        slim = _dealt(salted.join(met, ["digest", "_deal"]).drop("_deal"))
        revisit = F.coalesce((F.col("n") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
        name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
        target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
        header = F.concat(
            F.lit(f"WARC/1.1{END}"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", name("page_id")),
            _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", target),
            F.when(revisit, F.concat(_line("WARC-Refers-To", name("first_id")), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), _line("Content-Type", F.lit("text/html; charset=utf-8")),
            _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")), F.lit(END),
        )
        slim.select("digest", "part", revisit.alias("bare"), F.lit(True).alias("own"), F.encode(header, "UTF-8").alias("header")).write.parquet(f"{self.path}/headers")

    def put(self, records: DataFrame, header: str = "header", payload: str = "payload") -> None:
        """Take in records that exist, into a new folder: their header blocks, with the empty line at the end, and blocks, as bytes.

        Both stay exactly as they are, whatever they hold; records() gives them back. Null is empty. A Content-Length
        that differs from the block's size fails when it is read. Equal records are records of their own.
        """
        binary = lambda c: F.coalesce(F.col(c).cast("binary"), F.lit(b""))
        rows = records.select(binary(header).alias("header"), binary(payload).alias("payload")).withColumn("digest", F.sha2("payload", 256))
        self._store(rows.select("digest", "payload"))
        slim = cut(rows.select("digest", "header", F.monotonically_increasing_id().alias("_row")), "records")
        _dealt(slim).select("digest", "part", F.lit(False).alias("bare"), F.lit(False).alias("own"), "header").write.parquet(f"{self.path}/headers")

    def payloads(self) -> DataFrame:
        """digest, parts, payload; reading a payload whose digest is not its own fails."""
        held = self.spark.read.parquet(f"{self.path}/payloads")
        right = F.sha2("payload", 256) == F.col("digest")
        return held.select("digest", "parts", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")).alias("payload"))

    def read(self) -> DataFrame:
        """A row per record: page_id, url, record_type, refers_to, sha1 (as declared), header, payload (of revisits: that of
        what they refer to), record (the original bytes: header block, block, none in a revisit, and two line ends).

        Fails where a record's declared length, or the SHA-1 that write() declares, is not that of its bytes. Fields that
        a header does not have, or not as write() writes them, are null.
        """
        headers = self.spark.read.parquet(f"{self.path}/headers")
        dealt = self.payloads().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        joined = headers.join(dealt, ["digest", "part"]).withColumn("_h", F.col("header").cast("string"))
        h = F.col("_h")
        block = F.when(F.col("bare"), F.lit(b"")).otherwise(F.col("payload"))
        length = _field(h, "Content-Length", r"[0-9]+")
        wrong = F.coalesce(length.cast("long") != F.octet_length(block), F.lit(False)) | (F.col("own") & ~F.coalesce(F.sha1("payload") == _field(h, "WARC-Payload-Digest", r"sha1:[0-9a-f]*").substr(6, 40), F.lit(False)))
        record = F.concat(F.when(wrong, F.raise_error(F.concat(F.lit("a record is not as declared: "), h)).cast("binary")).otherwise(F.col("header")), block, F.lit(b"\r\n\r\n"))
        own_id = lambda name: F.regexp_extract(h, rf"\r\n{name}: <urn:page:([0-9-]+)>\r\n", 1).try_cast("long")
        return joined.select(
            own_id("WARC-Record-ID").alias("page_id"), _field(h, "WARC-Target-URI").alias("url"), _field(h, "WARC-Type").alias("record_type"), own_id("WARC-Refers-To").alias("refers_to"),
            _field(h, "WARC-Payload-Digest", r"sha1:[0-9a-f]*").substr(6, 40).alias("sha1"), "header", "payload", record.alias("record"),
        )

    def records(self) -> DataFrame:
        """page_id and record."""
        return self.read().select("page_id", "record")

    def export(self, path: str) -> None:
        """Write the records as .warc text files (a file per task). Fails for records that are not UTF-8; records() has those as bytes."""
        text = F.validate_utf8(F.col("record").cast("string"))
        self.read().select(text.substr(F.lit(1), F.length(text) - 4).alias("value")).write.option("lineSep", END * 2).text(path)
