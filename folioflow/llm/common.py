"""Scratch tables, shared folders and small helpers that the corpus operators have in common."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters (fixed by the result contracts).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a new temporary one in local mode (tests), and an error
    on a cluster, whose executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, want: str) -> str:
    """``want``, with underscores put after it until no column of ``df`` has a name that begins with it (case aside): it may be used with any ending."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(want.lower()) for c in taken):
        want += "_"
    return want


def own(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever signs are in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def map_rows(df: DataFrame, run) -> DataFrame:
    """``df.mapInArrow`` for functions that leave the columns as they are, whatever signs are in their names."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.mapInArrow(run, flat.schema).toDF(*df.columns)


#: The largest number of bits of an ``IdField``: 32 MB.
FIELD_BITS = 28


class IdField:
    """A field of bits that says of 64-bit keys whether they may be among those it was made of. It has 16 bits a key up to ``FIELD_BITS`` in all, so it can be
    broadcast whatever the number of keys; with more, it lets more other keys pass."""

    def __init__(self, keys: DataFrame):
        """Of ``keys`` (one column of longs without nulls), a written table."""
        self.bits = min(FIELD_BITS, max(16, (16 * keys.count()).bit_length()))

        def run(batches):
            field = np.zeros(1 << self.bits - 6, np.uint64)
            for b in batches:
                at = self._slots(b.column(0).to_numpy())
                np.bitwise_or.at(field, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            at = np.flatnonzero(field)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(field[at].view(np.int64))], names=["at", "word"])

        # At most one row of 12 bytes for each word of the field.
        rows = keys.mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        self.field = np.zeros(1 << self.bits - 6, np.uint64)
        self.field[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        return (self.field[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
