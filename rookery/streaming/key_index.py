"""Keys of all batches so far, kept so that a new batch finds its own among them without reading them all.

Keys lie by batch and hash bucket, and each such part has a Bloom filter of ``BITS`` bits a key. A batch's keys are tested
against the filters of their buckets, and only parts that some key may be in are opened, to see. A key that is in none is
taken for one with odds of about 7e-5, which costs a read and changes nothing. So a batch reads filters, 2.5 bytes for each
key there is, and the parts that hold repetitions.

A batch that is added again replaces itself, and is never asked about itself. Null is a key like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import saved

BITS, PROBES = 20, 14


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row per probe."""
    with np.errstate(over="ignore"):
        h = hashes.view(np.uint64)
        step = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        return (h[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step[None, :]) % np.uint64(bits)


def bloom_filter(hashes: np.ndarray) -> bytes:
    bits = -(-max(len(hashes), 1) * BITS // 8) * 8
    out = np.zeros(bits, bool)
    out[_places(hashes, bits).ravel()] = True
    return np.packbits(out).tobytes()


def may_hold(flt: bytes, hashes: np.ndarray) -> np.ndarray:
    data = np.frombuffer(flt, np.uint8)
    at = _places(hashes, 8 * len(data))
    return (data[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).all(axis=0)


class KeyIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _hashed(self, keys: DataFrame) -> DataFrame:
        h = F.xxhash64("key")
        return keys.select("key", h.alias("h"), F.pmod(h, F.lit(self.buckets)).cast("int").alias("bucket")).distinct()

    def _filters(self, but: int) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filters")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("bucket int, filter binary, batch long").parquet(f"{self.path}/filters").where(F.col("batch") != but)

    def add(self, keys: DataFrame, batch: int) -> None:
        """Keeps the keys (key) of a batch."""
        own = f"{self.path}/keys/batch={batch}"
        self._hashed(keys).repartitionById(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(own)

        def build(rows: pa.Table) -> pa.Table:
            data = bloom_filter(rows["h"].to_numpy())
            return pa.table({"bucket": rows["bucket"][:1].cast(pa.int32()), "filter": pa.array([data], pa.binary())})

        hashes = self.spark.read.schema("h long, bucket int").parquet(own)
        filters = hashes.groupBy("bucket").applyInArrow(build, "bucket int, filter binary")
        filters.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch}")

    def known(self, keys: DataFrame, batch: int) -> DataFrame:
        """Those of ``keys`` (key) that another batch than ``batch`` has."""
        filters = self._filters(batch)
        if filters is None:
            return keys.limit(0)
        asked, kind = self._hashed(keys), keys.schema["key"].dataType.simpleString()

        def test(own: pa.Table, kept: pa.Table) -> pa.Table:
            hashes, names = own["h"].to_numpy(), own["key"].combine_chunks()
            out = []
            for flt, number in zip(kept["filter"], kept["batch"].to_pylist(), strict=True):
                hit = pa.array(may_hold(flt.as_py(), hashes)) if len(hashes) else pa.array([], pa.bool_())
                out.append(pa.table({"key": names.filter(hit), "bucket": own["bucket"].combine_chunks().filter(hit), "batch": pa.array([number] * hit.true_count, pa.int64())}))
            empty = pa.table({"key": names[:0], "bucket": pa.array([], pa.int32()), "batch": pa.array([], pa.int64())})
            return pa.concat_tables([empty, *out])

        hits = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(test, f"key {kind}, bucket int, batch long")
        hits = saved(hits, "hits")
        parts = [f"{self.path}/keys/batch={r.batch}/bucket={r.bucket}" for r in hits.select("batch", "bucket").distinct().collect()]  # names of parts
        if not parts:
            return keys.limit(0)
        there = self.spark.read.schema(f"key {kind}, batch long, bucket int").option("basePath", f"{self.path}/keys").parquet(*parts)
        same = (hits["batch"] == there["batch"]) & (hits["bucket"] == there["bucket"]) & hits["key"].eqNullSafe(there["key"])
        return hits.join(there, same, "left_semi").select("key").distinct()
