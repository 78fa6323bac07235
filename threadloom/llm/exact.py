"""Exact deduplication by a stateful stream, in DataFrame operations only.

Texts that come in are written once to a content store, files of (digest, id, text). Their digests stream into
an aggregation whose keyed state lies on disk (RocksDB) and never expires. For each digest the state retains the stable
identifier to keep (the largest id), the number of rows and a content locator: the file that holds the text that came first. When a
digest is hit, the bytes are fetched through its locator and compared with those of the new rows; digests that turn out to
belong to several texts are kept in a table of their own and told apart by full texts from then on. Store, state and that table live in
one folder, so that each later ``ingest`` is held against all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import digest_of, path_exists, shared_path, sized, written

#: A table of digests may be broadcast with at most so many rows.
BROADCAST_DIGESTS = 250_000
#: Up to so many content files are named to the reader one by one; beyond, the whole store is read and the locators joined.
NAMED_FILES = 2_000
_STORE = "spark.sql.streaming.stateStore."
#: Session settings while the stream runs: state on disk, change logs instead of whole snapshots, no preallocated files.
STATE_STORE = {
    _STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STORE + "rocksdb.changelogCheckpointing.enabled": "true",
    _STORE + "rocksdb.allowFAllocate": "false",
}


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _digest(text_col: str) -> Column:
    return digest_of(text_col)


def stream_state(digests_path: str, spark, checkpoint: str, out: str) -> None:
    """Feed every digest file that ``checkpoint`` has not seen into the state; changed keys go to ``out``, a folder a batch.

    A second call with the same three paths takes only new files, so a corpus can grow. A batch that is
    repeated after a failure overwrites its own folder.
    """
    kinds = "doc_id long, digest binary, n_bytes long, locator string, arrived long"
    stream = spark.readStream.schema(kinds).parquet(digests_path)
    state = stream.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.count("*").alias("group_size"),
        F.min_by("locator", F.struct("arrived", "locator")).alias("locator"),
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def ingest(new_docs: DataFrame, state_dir: str, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Take rows in, under a name that is new to ``state_dir``; returns (doc_id, keep_id, group_size, kept, text_sha256, locator) for them.

    Groups are of all rows that the folder has ever taken in, which lies where driver and executors share it. An ingest that failed
    is repeated by calling it again with its name: what it wrote is taken up and no row counts twice.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the largest id stays; an earlier
    row that gives way shows in ``ingested``. Rows with a null id stay only if their whole group has none; repeated rows with the kept
    id are all marked kept (``drop_copies`` leaves one of them). An empty table gives an empty result; further columns
    of the input are not read.
    """
    spark = new_docs.sparkSession
    content, digests, mixed = f"{state_dir}/content/{name}", f"{state_dir}/digests/{name}", f"{state_dir}/mixed"
    if not path_exists(spark, f"{digests}/_SUCCESS"):
        own = new_docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("digest"), _text(text_col).alias("text"))
        own.write.mode("overwrite").parquet(content)
        arrived = F.lit(len(_names(spark, f"{state_dir}/digests")))
        stored = spark.read.schema(_CONTENT).parquet(content)
        stored.select(
            "doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.input_file_name().alias("locator"), arrived.cast("long").alias("arrived")
        ).write.mode("overwrite").parquet(digests)
    stream_state(f"{state_dir}/digests/*", spark, f"{state_dir}/checkpoint", f"{state_dir}/changes")

    rows = spark.read.schema(_ROWS).parquet(digests)
    state = _state(spark, state_dir)
    fresh = written(rows.select("digest").distinct(), "exact-fresh")
    hits = written(state.filter("group_size > 1").join(sized(fresh, BROADCAST_DIGESTS), "digest", "left_semi").select("digest", "locator"), "exact-hits")
    few = sized(hits, BROADCAST_DIGESTS)
    # the new rows' bytes, and through the locators those that each digest had before
    files = [r["locator"] for r in hits.select("locator").distinct().limit(NAMED_FILES + 1).collect()]
    if files:
        everything = spark.read.schema(_CONTENT)
        before = everything.parquet(*files) if len(files) <= NAMED_FILES else everything.parquet(f"{state_dir}/content/*")
        before = before.select("digest", "text", F.input_file_name().alias("locator")).join(few, ["digest", "locator"], "left_semi").select("digest", "text")
        new = everything.parquet(content).select("digest", "text").join(few.select("digest"), "digest", "left_semi")
        texts = new.unionByName(before).groupBy("digest", "text").agg(F.lit(1).alias("one"))
        texts.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest").write.mode("overwrite").parquet(f"{mixed}/{name}")
    return _grouped(spark, state_dir, name, state)


def ingested(spark: SparkSession, state_dir: str) -> DataFrame:
    """The rows of ``ingest`` for everything that the folder has taken in so far, as the groups are now."""
    return _grouped(spark, state_dir, "*", _state(spark, state_dir))


_CONTENT, _ROWS = "doc_id long, digest binary, text string", "doc_id long, digest binary"


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of complete folders below a path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def _state(spark: SparkSession, state_dir: str) -> DataFrame:
    """(digest, keep_id, group_size, locator): the last change of every digest."""
    kinds = "digest binary, keep_id long, group_size long, locator string, batch int"
    if not _names(spark, f"{state_dir}/changes"):
        return spark.createDataFrame([], kinds).drop("batch")
    changes = spark.read.schema(kinds).parquet(f"{state_dir}/changes")
    last = changes.groupBy("digest").agg(F.max_by(F.struct("keep_id", "group_size", "locator"), "batch").alias("s"))
    return last.select("digest", "s.keep_id", "s.group_size", "s.locator")


def _grouped(spark: SparkSession, state_dir: str, name: str, state: DataFrame) -> DataFrame:
    """The rows of an ingest, or of all (``*``), with their groups. Only digests with several rows are joined: the others are groups of their own."""
    rows = spark.read.schema(_ROWS).parquet(f"{state_dir}/digests/{name}")
    groups = written(state.filter("group_size > 1"), "exact-groups")
    lone = (F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    joined = rows.join(sized(groups, BROADCAST_DIGESTS).withColumnRenamed("keep_id", "of"), "digest", "left")
    placed = joined.select(
        "doc_id", "digest", F.when(F.col("group_size").isNull(), lone[0]).otherwise(F.col("of")).alias("keep_id"), F.coalesce("group_size", lone[1]).alias("group_size"), "locator"
    )
    names = _names(spark, f"{state_dir}/mixed")
    mixed = spark.read.schema("digest binary").parquet(f"{state_dir}/mixed/*").distinct() if names else None
    if mixed is not None and mixed.limit(1).count():
        few = sized(written(mixed, "exact-mixed"), BROADCAST_DIGESTS)

        def held(part: str) -> DataFrame:
            return spark.read.schema(_CONTENT).parquet(f"{state_dir}/content/{part}").join(few, "digest", "left_semi")

        texts = held("*").groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        own = held(name).join(texts, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size", F.lit(None).cast("string").alias("locator"))
        placed = placed.join(mixed, "digest", "left_anti").unionByName(own)
    return placed.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.expr("doc_id <=> keep_id").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "locator",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ingest`` of one table into a folder of its own: (doc_id, keep_id, group_size, kept, text_sha256, locator), one row per input row."""
    return ingest(docs, shared_path(docs.sparkSession, "exact-state"), "all", id_col, text_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id. All columns stay.

    Of rows that repeat both id and text one stays; which of them is not defined where further columns differ. Rows that share an
    id but not the text are judged each by its own text. Of texts that only rows without an id have one row stays.
    """
    groups = written(exact_groups(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"), "exact-groups")
    gone = sized(
        written(
            groups.filter("not kept").select(F.col("doc_id").alias("__gone_id"), F.col("text_sha256").alias("__gone_sha")).distinct(),
            "exact-drops",
        ),
        BROADCAST_DIGESTS,
    )
    sha = F.sha2(_text(text_col), 256)
    left = docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col("__gone_id")) & (sha == F.col("__gone_sha")), "left_anti")
    kept = groups.filter("kept").agg(F.count("*").alias("n"), F.count_distinct("text_sha256").alias("d")).first()
    if kept["n"] == kept["d"]:
        return left
    return left.withColumn("__sha", sha).dropDuplicates(["__sha"]).drop("__sha")
