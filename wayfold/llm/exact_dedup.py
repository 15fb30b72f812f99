"""Exact deduplication over a persistent digest index (DataFrame functions only).

The index is a Parquet table with a row for each distinct normalised text: its SHA-256
digest, and the document that stays.  It is bucketed and sorted by digest, so that a new
batch is compared with it by a sort-merge anti-join for which the index needs neither a
shuffle nor a sort; what is new is appended.

Defined results: a null text counts as empty; empty texts equal each other; of equal texts
one row stays, that with the most code points in the original, then the smallest doc_id, then the first as
read; group_size counts rows, also those that repeat a doc_id.  A null doc_id orders last.
An empty table gives an empty result.  Extra columns pass through :func:`deduplicate`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import fresh_path, saved, table, unused

#: Space and U+0009 to U+000D, which do not count in a comparison.
IGNORED = " \t\n\x0b\x0c\r"
#: Sorts null ids last.
NO_ID = 2**63 - 1


def normalised(text):
    out = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_code_points and digest (32 bytes) of every row."""
    text = F.col("text")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce(text, F.lit(""))).alias("n_code_points"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
    )


def best_of_each(rows: DataFrame) -> DataFrame:
    """The staying document (its id, and the number of its row) and the size of each group of equal digests.

    Map-side partial aggregation reduces a group of copies to a row per task before the
    shuffle, however large it is.
    """
    order = F.struct(F.col("n_code_points"), (-F.coalesce("doc_id", F.lit(NO_ID))).alias("id"), (-F.col("row")).alias("row"))
    best = rows.groupBy("digest").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return best.select("digest", F.nullif(-F.col("best.id"), F.lit(NO_ID)).alias("keep_id"), (-F.col("best.row")).alias("keep_row"), "group_size")


class DigestIndex:
    """A digest index at ``path``: Parquet, bucketed and sorted by digest.

    Its number of buckets is written beside it when it is made, and holds from then on.  After
    appends a bucket has several files, so it is read without a shuffle and sorted as it is read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        self.name = f"wayfold_digests_{uuid.uuid4().hex[:12]}"
        self.buckets = self._settled(int(buckets))
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _settled(self, buckets: int) -> int:
        note = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_buckets")
        fs = note.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(note):
            stream = fs.open(note)
            buckets = stream.readInt()
        else:
            stream = fs.create(note)
            stream.writeInt(buckets)
        stream.close()
        return buckets

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def absent(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index doesn't have."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def known(self, groups: DataFrame) -> DataFrame:
        """The index's rows for the digests of ``groups``."""
        return self.read().join(groups.select("digest").hint("merge"), "digest", "left_semi")

    def add(self, new: DataFrame) -> None:
        new.select("digest", "keep_id", "group_size").write.insertInto(self.name)

    def close(self) -> None:
        """Forget the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def buckets_for(rows: int) -> int:
    """Buckets of a new index: 64, or more for some four million digests a bucket."""
    return max(64, 1 << max(0, (rows >> 22)).bit_length())


def _decided(docs: DataFrame, index_path: str | None, buckets: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The numbered digests of all rows, the groups that are new (digest, keep_id, keep_row, group_size), and what the
    index has of the others.  The new groups are appended."""
    spark = docs.sparkSession
    rows = saved(digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    groups = saved(best_of_each(rows), "groups")
    index = DigestIndex(spark, index_path or fresh_path(spark, "index"), buckets or buckets_for(groups.count()))
    new = saved(index.absent(groups), "new")
    old = saved(index.known(groups), "known")
    index.add(new)
    index.close()
    return rows, new, old


def decisions(docs: DataFrame, index_path: str | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    One row of a group is kept: where rows tie in length and doc_id, the first as read.  With an
    index that other batches have filled, a text known to it is dropped in favour of the document that came
    first, whatever the ids; group_size is then that of the batch in which the text was new.
    """
    rows, new, old = _decided(docs, index_path, buckets)
    decided = new.unionByName(old.withColumn("keep_row", F.lit(None).cast("long")))
    # A plain shuffle of both sides, one of which has a row for a digest, so that adaptive execution can split a hot one.
    return rows.join(decided.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index_path: str | None = None, buckets: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text, the longest, then that with the smallest
    doc_id, then the first by its columns' hashes."""
    of, nth, kept_id, kept_digest = unused(docs, "__of", "__nth", "__kept_id", "__kept_digest")
    _, new, _ = _decided(docs, index_path, buckets)
    kept = new.select(F.col("keep_id").alias(kept_id), F.col("digest").alias(kept_digest))
    named = docs.withColumn(of, F.unhex(F.sha2(normalised(docs["text"]), 256)))
    same = named["doc_id"].cast("long").eqNullSafe(kept[kept_id]) & (named[of] == kept[kept_digest])
    out = named.join(kept.hint("merge"), same, "left_semi")
    longest = Window.partitionBy("doc_id", of).orderBy(F.length(F.coalesce("text", F.lit(""))).desc(), F.xxhash64(*docs.columns), F.hash(*docs.columns))
    return out.withColumn(nth, F.row_number().over(longest)).where(F.col(nth) == 1).drop(nth, of)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
g AS (
  SELECT h, count(*) AS group_size, arg_max(doc_id, n * 10000000000 - doc_id) AS keep_id FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256
FROM t JOIN g USING (h)
"""
