"""Exact deduplication against a persistent index of digests.

The index is a table of (digest, id, row, delivery), bucketed by digest and sorted by it inside each bucket, one row per
text ever seen. A delivery is grouped by digest first, with combination before the shuffle, so a text that makes up a third
of all rows travels as one row per task. Its groups then meet the index in a sort-merge anti-join that reads the index
bucket by bucket without shuffling it, and what is new is appended to the same buckets. Of equal texts in one delivery the
row with the largest id stays; a text that an earlier delivery brought keeps the row it has.

Appends become visible by a commit row, written last. What a lost driver left of an append is never read, a delivery that
is added again does nothing, and lost executors only cost their tasks.

Verdicts join the rows with one row per text. A text with more than a thousandth of the rows meets them by broadcast: there
are fewer than a thousand such texts, whatever the size of the table. All others go through a sort-merge join.

Defined cases: a null text is an empty one; a null id is smaller than any other; of rows that repeat id and text one stays;
an empty delivery adds nothing. Columns other than id and text are not carried, so their names cannot clash. Digests are
SHA-256 of the whole text, which stands for its equality.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import saved

HOT = 1000


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", *, delivery: Column | str = "0", normal=lambda c: c) -> DataFrame:
    """(id, row, delivery, digest) of every row, written once. ``normal`` makes texts equal that are to count as equal."""
    label = F.lit(delivery) if isinstance(delivery, str) else delivery
    own = F.unhex(F.sha2(normal(F.coalesce(F.col(text), F.lit(""))), 256))
    return saved(docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), label.alias("delivery"), own.alias("digest")), "digests")


class DigestIndex:
    """The index below ``path``, a folder that all executors share. ``buckets`` and ``id_type`` hold from its creation."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        if not self._exists("shape"):
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(buckets, id_type)], "buckets int, id_type string").coalesce(1).write.parquet(f"{self.path}/shape")
        self.buckets, id_type = spark.read.schema("buckets int, id_type string").parquet(f"{self.path}/shape").first()
        self.table = "digests_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        columns = f"digest BINARY, id {id_type}, row BIGINT, delivery STRING, attempt STRING"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def commits(self) -> dict[str, str]:
        """The attempt that counts of each delivery; a row per delivery."""
        if not self._exists("commits"):
            return {}
        rows = self.spark.read.schema("delivery string, attempt string").parquet(f"{self.path}/commits").collect()
        return {r.delivery: r.attempt for r in rows}

    def read(self) -> DataFrame:
        """(digest, id, row, delivery) of the texts that are known."""
        self.spark.catalog.refreshTable(self.table)
        known = self.spark.table(self.table).where(F.col("attempt").isin(list(self.commits().values())))
        return known.drop("attempt")

    def add(self, rows: DataFrame, delivery: str) -> None:
        """Appends the texts of ``rows`` (id, row, digest) that no earlier delivery had."""
        if delivery in self.commits():
            return
        best = F.max(F.struct("id", "row")).alias("best")
        new = rows.groupBy("digest").agg(best).select("digest", "best.id", "best.row")
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            new = new.repartition(self.buckets, "digest")  # the index stays where it is
        fresh = new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        attempt = uuid.uuid4().hex
        fresh.select("digest", "id", "row", F.lit(delivery), F.lit(attempt)).write.insertInto(self.table)
        self.spark.createDataFrame([(delivery, attempt)], "delivery string, attempt string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """id, keep_id, group_size (in ``rows``), kept and digest of every one of ``rows`` that were added."""
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            sizes = sizes.repartition(self.buckets, "digest")
        index = self.read().select("digest", F.col("id").alias("keep_id"), F.col("row").alias("_row"), F.col("delivery").alias("_delivery"))
        known = saved(sizes.join(index.hint("merge"), "digest"), "known")
        total = known.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        often = F.col("group_size") * HOT > total
        hot, rest = F.broadcast(known.where(often)), known.where(~often)
        met = rows.join(hot, "digest").unionByName(rows.join(F.broadcast(known.where(often).select("digest")), "digest", "left_anti").join(rest.hint("merge"), "digest"))
        stays = (F.col("row") == F.col("_row")) & (F.col("delivery") == F.col("_delivery"))
        return met.select("id", "keep_id", "group_size", stays.alias("kept"), "digest")


def deduplicate(docs: DataFrame, index: DigestIndex, delivery: str, key: str = "doc_id", text: str = "text", normal=lambda c: c) -> DataFrame:
    """One delivery: adds its texts to the index and returns the verdict on each of its rows."""
    rows = digests(docs, key, text, delivery=delivery, normal=normal)
    index.add(rows, delivery)
    return index.verdicts(rows)
