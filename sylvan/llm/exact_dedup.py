"""Exact deduplication through a persistent digest index (DataFrame operations only).

The index is a table of (bucket, digest, keep_id, group_size), bucketed and sorted by the digest. A batch is reduced to
one row per digest (partial aggregation before the shuffle, so a hot group of copies sends one row per map task), a
sort-merge anti-join against the index yields the new digests, and those are appended. Copies that a later batch has of
known texts are counted beside the index.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.llm.common import ascii_lower, shared_dir, written

INDEX, MORE = "text_sha256 string, keep_id long, group_size long", "text_sha256 string, n long"


def digests(docs: DataFrame) -> DataFrame:
    """docs plus text_sha256: SHA-256 of the text with A-Z lower-cased. Null text counts as empty."""
    return docs.withColumn("text_sha256", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))


class DigestIndex:
    """Digest index in the files at `path`, by default in the shared folder under a new name.

    A path that holds an index, of whatever session, is attached to: its digests count and appends add to them. buckets is
    the number of hash buckets of a new index; at 100 TB use some thousands. An index keeps the number it was made with, which
    stands beside its files. Batches are appended one at a time. keep_id stays that of the batch that brought the text first;
    group_size counts the rows of all batches.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16):
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
        self.table = f"digests_{uuid.uuid4().hex}"
        self._exists = False
        if path:
            self._attach()

    def _found(self, path: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise

    def _attach(self) -> None:
        noted = self._found(f"{self.path}/_buckets", "buckets int")
        if noted is not None:
            self.buckets = noted.first()[0]
            self._create()
        elif self._found(self.path, INDEX) is not None:
            # Made before the number was noted: `buckets` must be that of its making.
            self._note()
            self._create()

    def _note(self) -> None:
        # Hidden from readers of the path by its underscore.
        self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.parquet(f"{self.path}/_buckets")

    def _create(self) -> None:
        """Name the files at path, so that appends add to them."""
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {self.table} ({INDEX}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        self._exists = True

    def _write(self, rows: DataFrame) -> None:
        (rows.write.mode("append").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").format("parquet").saveAsTable(self.table))

    def _table(self) -> DataFrame:
        if not self._exists:
            self._note()
            self._create()
        # Another object may have appended.
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def read(self) -> DataFrame:
        """text_sha256, keep_id, group_size of every text that any batch had. Read by path, not by table, so that a join with
        rows shuffles both sides and a hot digest can be split over tasks."""
        self._table()
        rows, more = self.spark.read.schema(INDEX).parquet(self.path), self._found(f"{self.path}/_more", MORE)
        if more is None:
            return rows
        more = more.groupBy("text_sha256").agg(F.sum("n").alias("n"))
        return rows.join(more, "text_sha256", "left").select("text_sha256", "keep_id", (F.col("group_size") + F.coalesce("n", F.lit(0))).alias("group_size"))

    def _batch(self, docs: DataFrame) -> DataFrame:
        return digests(docs).groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))

    def new_digests(self, docs: DataFrame) -> DataFrame:
        """One row per digest of docs that the index lacks: text_sha256, keep_id (largest doc_id), group_size."""
        return self._batch(docs).join(self._table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def append(self, docs: DataFrame) -> DataFrame:
        """Append the digests that docs adds and count the copies of known ones; returns the index."""
        first = not self._exists
        new = self.new_digests(docs).repartition(self.buckets, "text_sha256")
        if not first:
            # The new ones must be fixed before counts are written, the counts before the new ones are known.
            new = written(new, "new")
            known = self._batch(docs).join(self._table().select("text_sha256").hint("merge"), "text_sha256", "left_semi")
            known.select("text_sha256", F.col("group_size").alias("n")).write.mode("append").parquet(f"{self.path}/_more")
            new = new.repartition(self.buckets, "text_sha256")
        self._write(new)
        return self.read()

    def close(self) -> None:
        """Forget the table's name; the files stay at `path`."""
        if self._exists:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """docs' columns doc_id, text_sha256 with keep_id, group_size and kept, one row per input row.

    Texts are equal when identical after lower-casing A-Z. The row with the largest doc_id of a group stays; among rows
    that repeat that doc_id all are marked kept, as nothing tells them apart. A null doc_id stays only if no doc_id of
    its group is set. Empty and null texts form one group. An empty table gives an empty result. Extra columns of docs
    are not read. With an index of earlier batches a text known there keeps its keep_id, so no row of this batch is kept for
    it unless it carries that doc_id. The join back to the rows is a shuffled sort-merge join, which AQE may split for a hot
    group.
    """
    index = index or DigestIndex(docs.sparkSession)
    found = index.append(docs)
    rows = digests(docs.select("doc_id", "text")).select("doc_id", "text_sha256")
    out = rows.join(found, "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates() drops, all columns kept.

    Of kept rows that repeat doc_id one stays, that with the smallest text. Null and empty texts are one group, of which the
    largest doc_id stays; a null doc_id stays only if its group has no other. An empty table stays empty.
    """
    index = DigestIndex(docs.sparkSession)
    kept = index.append(docs).select(F.col("text_sha256").alias("__kept"), F.coalesce("keep_id", F.lit(0)).alias("__id"), F.isnull("keep_id").alias("__null"))
    # A null doc_id equals a null one; both sides of the join and the window are dealt by the same keys.
    rows = digests(docs).select(*docs.columns, F.col("text_sha256").alias("__h"), F.coalesce("doc_id", F.lit(0)).alias("__d"), F.isnull("doc_id").alias("__n"))
    rows = rows.join(kept, (F.col("__h") == F.col("__kept")) & (F.col("__d") == F.col("__id")) & (F.col("__n") == F.col("__null")), "left_semi")
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy("__h", "__d", "__n").orderBy("text"))).where("__i = 1").select(*docs.columns)
