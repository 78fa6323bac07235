"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast when it has at most this many rows of a few machine words each.
BROADCAST_ROWS = 1_000_000
#: And a side of texts when they have at most so many bytes.
BROADCAST_BYTES = 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session (one JVM) takes a folder below its warehouse, and a cluster raises an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/threadloom-checkpoints")
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/threadloom/{uuid.uuid4().hex}-{label}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable, rows: int = 1000) -> Iterator:
    """The same batches, some rows at a time, so that what a task makes of them stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs lie on the executors' disks until the driver has collected what refers to them; this has it do so now."""
    gc.collect()
    for _ in range(2):  # what the first round frees holds more
        spark._jvm.System.gc()
        time.sleep(0.2)


def discard(table: DataFrame) -> None:
    """Removes the files of a written table that nothing will read again."""
    files = table.inputFiles()
    if files:
        remove_path(table.sparkSession, files[0].rpartition("/")[0])


class Chain:
    """Tables that follow one another, each made from the one before: when one is written, the one before goes."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.path = spark, label, ""

    def put(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, shared_path(self.spark, self.label)
        df.write.parquet(self.path)
        if before:
            remove_path(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(self.path)


def sized(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it is known to be small, else as it is. ``side`` should be a written table: it is counted."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def sized_texts(side: DataFrame, *columns: str) -> DataFrame:
    """``side`` with a broadcast hint if these text columns are known to be small together, else as it is."""
    total = side.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(64))).alias("n")).first()["n"] or 0
    return F.broadcast(side) if total <= BROADCAST_BYTES else side


def table_bytes(side: DataFrame, *columns: str) -> int:
    """What these text columns take together, with some bytes a row for the rest."""
    return side.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(64))).alias("n")).first()["n"] or 0


def digest_of(text_col: str) -> Column:
    """What tells texts apart: the SHA-256 of the bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def without_rows(df: DataFrame, id_col: str, text_col: str, drops: DataFrame) -> DataFrame:
    """Rows of ``df`` that aren't in ``drops(doc_id, digest)``: rows are the same where id and text are. Null ids equal each other."""
    gone = drops.select(F.col("doc_id").alias("__gone_id"), F.col("digest").alias("__gone_digest")).distinct()
    gone = written(gone, "gone")
    same = df[id_col].cast("long").eqNullSafe(F.col("__gone_id")) & (digest_of(text_col) == F.col("__gone_digest"))
    return df.join(sized(gone, BROADCAST_ROWS // 4), same, "left_anti")
