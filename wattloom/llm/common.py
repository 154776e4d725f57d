"""Helpers shared by the operators: shipping the code, batches of bounded size, samples."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per Spark application (they may not share the
    driver's folders)."""
    sc = spark.sparkContext
    if getattr(sc, "_wattloom_sent", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "wattloom_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._wattloom_sent = True


def slices(batches: Iterator[pa.RecordBatch], col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `limit` bytes of `col`, or one row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64) + 64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield b.slice(a, z - a)


def fold_of(key: str, parts: int) -> Column:
    """crc32 of the key's text, modulo `parts`; NULL keys give NULL."""
    return F.crc32(F.col(key).cast("string")) % parts


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, bound: int, usable: Column, key: str = "doc_id"
) -> DataFrame:
    """(text, label): at most `bound` labelled rows, those with the smallest key hashes.

    `usable` limits the rows that may be learnt from. The choice depends on the key alone, so a
    recomputed task gives the same rows. At most `bound` keys are sent to the executors. A key
    labelled twice takes its larger label; of documents that share a key the smallest text counts.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & usable)
        .groupBy(F.col(key).alias("__key"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(bound)
    )
    text = docs.select(F.col(key).alias("__doc"), F.col("text").cast("string").alias("text"))
    joined = text.join(F.broadcast(chosen), F.col("__doc") == F.col("__key"))
    return joined.groupBy("__key").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table, by the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
