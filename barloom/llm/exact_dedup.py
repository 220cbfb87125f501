"""Exact dedup against a persistent index of digests, with DataFrame functions only.

The index is a Parquet table partitioned by batch, bucketed and sorted by digest. New rows are reduced to one row per
digest, anti-joined with the index by sort-merge (the index side is read in its buckets, without a shuffle) and
appended as a batch. A batch that is added again, say after a crash, replaces itself and gives the same result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import cut, with_group


def text_digest(text: str) -> Column:
    """SHA-256 in hex of the text with each run of ASCII white space made one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


class DigestIndex:
    """Digests seen so far: digest, keep_id (the row that stays for it), batch.

    path: a folder for its files, by which a later session finds it without a shared catalog.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, path: str | None = None):
        self.spark, self.name, self.buckets, self.path = spark, name, buckets, path

    def create(self) -> None:
        """An empty index, unless there is one."""
        if self.spark.catalog.tableExists(self.name):
            return
        at = f" LOCATION '{self.path}'" if self.path else ""
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS{at}"
        )
        if self.path:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def put(self, rows: DataFrame, batch: str) -> None:
        """The batch's rows (digest, keep_id), in place of those it had: one sorted file per bucket."""
        view = f"_barloom_{uuid.uuid4().hex}"
        rows.select("digest", "keep_id").repartition(self.buckets, "digest").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {_quoted(batch)}) SELECT digest, keep_id FROM {view}")
        self.spark.catalog.dropTempView(view)

    def read(self, without: str | None = None) -> DataFrame:
        """digest, keep_id of all batches but one; each digest once, without a shuffle."""
        held = self.spark.table(self.name)
        if without is not None:
            held = held.where(F.col("batch") != without)
        return held.groupBy("digest").agg(F.min("keep_id").alias("keep_id"))

    def compact(self, batch: str) -> None:
        """All batches as this one new batch, so that each bucket is one sorted file again.

        A crash on the way leaves digests in two batches, which read() takes as one. Batches that may yet be added
        again must not be compacted: their own digests would be known then.
        """
        old = [r[0] for r in self.spark.table(self.name).select("batch").distinct().collect()]  # a row per batch
        if batch in old:
            raise ValueError(f"batch {batch} is in the index")
        self.put(cut(self.read(), "index"), batch)
        for b in old:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = {_quoted(b)})")

    def add(self, docs: DataFrame, batch: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """Dedup docs against the index and among themselves, and append their new digests as the batch.

        Returns a row per row of docs: doc_id, keep_id, group_size (rows of docs with that text, and one more if the
        index held it before), kept, text_sha256. A text that another batch holds is never kept again. A null doc_id
        comes after all others, so it stays only for a text without any other. Rows that repeat both doc_id and text
        are all marked kept (keep() returns one of them). Empty and null texts are one group. Other columns of docs
        do not matter here.
        """
        return self._add(docs, batch, text, doc_id).drop("h1", "h2")

    def _add(self, docs: DataFrame, batch: str, text: str, doc_id: str) -> DataFrame:
        h1, h2 = _text_keys(text)
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_digest(text).alias("digest"), h1.alias("h1"), h2.alias("h2"))
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "digests")
        grouped = with_group(rows, "digest", "_row", {
            "keep_id": (F.min("doc_id"), F.min("keep_id")), "group_size": (F.count(F.lit(1)), F.sum("group_size")),
        })
        self.create()
        before = self.read(without=batch).select("digest", F.col("keep_id").alias("_before"), F.lit(True).alias("_known"))
        mine = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        met = cut(mine.hint("merge").join(before, "digest").select("digest", "_before", "_known"), "known")
        new = mine.hint("merge").join(before, "digest", "left_anti")
        # Known digests are looked up before the new ones are appended, and written, since an overwrite must not read what it replaces.
        self.put(cut(new, "new"), batch)
        grouped = grouped.join(met, "digest", "left")
        known = F.coalesce("_known", F.lit(False))
        return grouped.select(
            "doc_id",
            F.when(known, F.col("_before")).otherwise(F.col("keep_id")).alias("keep_id"),
            (F.col("group_size") + F.when(known, 1).otherwise(0)).alias("group_size"),
            (~known & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.col("digest").alias("text_sha256"), "h1", "h2",
        )

    def keep(self, docs: DataFrame, batch: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """The rows of docs that stay, with all their columns: those that add() marks, and of rows that share doc_id and
        digest one. Texts are met by two hashes, so none is normalised twice."""
        marked = self._add(docs, batch, text, doc_id).where("kept")
        counted = marked.groupBy("text_sha256", "doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        least = counted.groupBy("text_sha256").agg(F.min(F.struct("doc_id", "h1", "h2", "n")).alias("k"))
        names = {c: f"_barloom_{c}" for c in ("doc_id", "h1", "h2", "n")}
        keep = cut(least.select(*(F.col(f"k.{c}").alias(n) for c, n in names.items())), "keep")
        h1, h2 = _text_keys(text)
        held = docs.withColumns({"_barloom_t1": h1, "_barloom_t2": h2})
        same = lambda k: held[doc_id].cast("long").eqNullSafe(k["_barloom_doc_id"]) & (held["_barloom_t1"] == k["_barloom_h1"]) & (held["_barloom_t2"] == k["_barloom_h2"])
        chosen = lambda k: held.join(k, same(k), "left_semi")
        more = chosen(keep.where("_barloom_n > 1")).dropDuplicates([doc_id, "_barloom_t1", "_barloom_t2"])
        return chosen(keep.where("_barloom_n = 1")).unionByName(more).drop("_barloom_t1", "_barloom_t2")


def _text_keys(text: str) -> tuple[Column, Column]:
    return F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scratch_index(spark: SparkSession) -> DigestIndex:
    """An index of its own, for one run."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts one row with the smallest doc_id, by way of a new index."""
    index = scratch_index(docs.sparkSession)
    out = index.keep(docs, "all", text, doc_id)
    index.drop()  # what is returned reads the digests written beside it
    return out
