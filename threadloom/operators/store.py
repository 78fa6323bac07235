"""Tables as versioned Parquet snapshots in buckets, and the keyed changes that the maintenance of an index needs.

The rows of a table lie in buckets by a hash of its key. One small file, the catalogue, names for every table the version that each bucket is
of. A change finds the buckets that its keys fall into, reads these alone, and writes them anew as the next version beside the
current one; the files of all other buckets stay as they are, and a change without keys writes nothing. Then a new catalogue takes
the old one's place by a rename, so readers see either, and the tables that are changed inside ``together`` change at
once or, where something fails, not at all. Changes are plain table-to-table functions and can be used without the store.

A store has one writer at a time, the one that holds its lock (``writing``).
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.segments import Catalogue
from threadloom.schemas import BUCKET_KEYS, TABLES


# -- changes ----------------------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; columns in ``keep`` stay as they were there."""
    rest = old.join(new.select(*keys), keys, "left_anti")
    if keep:
        known = old.select(*keys, *(F.col(c).alias(f"__{c}") for c in keep))
        new = new.join(known, keys, "left").select(
            *(F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns)
        )
    return rest.select(*old.columns).unionByName(new.select(*old.columns))


def replace_group(old: DataFrame, new: DataFrame, keys: list[str], gone: DataFrame | None = None) -> DataFrame:
    """``old`` with all rows of the groups in ``gone`` (of ``new`` without it) replaced by those of ``new``."""
    groups = (new if gone is None else gone).select(*keys).distinct()
    return old.join(groups, keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti").select(*old.columns)


def changed_files(found: DataFrame, manifest: DataFrame, always: tuple[str, ...] = ("pi",)) -> DataFrame:
    """Files that are new, or whose size or time differs from the manifest's; all of the providers in ``always``."""
    known = manifest.select("path", F.col("size").alias("__size"), F.col("mtime_ms").alias("__mtime"))
    both = found.join(known, "path", "left")
    same = F.col("size").eqNullSafe(F.col("__size")) & F.col("mtime_ms").eqNullSafe(F.col("__mtime"))
    return both.filter(F.col("provider").isin(*always) | ~same).drop("__size", "__mtime")


def deleted_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(found.select("path"), "path", "left_anti")


def orphans(sessions: DataFrame, links: DataFrame) -> DataFrame:
    """Sessions that no file backs."""
    return sessions.join(links.select("uid"), "uid", "left_anti")


def needs_chunks(sessions: DataFrame, chunks: DataFrame, version: str, limit: int | None = None) -> DataFrame:
    """Sessions of another chunk version or without chunks, the latest first."""
    stale = sessions.filter(~F.col("chunk_version").eqNullSafe(version)).unionByName(
        sessions.filter(F.col("chunk_version") == version).join(chunks.select("uid"), "uid", "left_anti").select(*sessions.columns)
    )
    return stale.orderBy(F.desc("updated_at"), F.desc("uid")).limit(limit) if limit else stale


def pending_chunks(chunks: DataFrame, sessions: DataFrame, limit: int | None = 10_000) -> DataFrame:
    """Chunks to embed, failed ones too, those of the latest sessions first."""
    todo = chunks.filter(F.col("embedding_status").isin("pending", "failed")).join(sessions.select("uid", "updated_at"), "uid")
    todo = todo.orderBy(F.desc("updated_at"), F.asc("chunk_id"))
    return todo.limit(limit) if limit else todo


def status_counts(chunks: DataFrame, status: str = "embedding_status") -> DataFrame:
    def count(value: str) -> Column:
        return F.count_if(F.col(status) == value).alias(value)

    return chunks.agg(F.count("*").alias("total"), count("pending"), count("embedded"), count("failed"))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


# -- snapshots --------------------------------------------------------------------------------------------------------


#: Buckets of a table that is written as a whole. At many terabytes some thousands keep a bucket at a few files.
BUCKETS = 16
#: A lock that has not been renewed for so many seconds is that of a writer that died.
STALE_SECONDS = 86_400
_HERE: dict[str, threading.RLock] = {}


class Busy(RuntimeError):
    """Another writer holds the lock of the store."""


def changed(old: DataFrame, keys: list[str], new: DataFrame | None, gone: DataFrame | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` without the rows that have keys of ``gone`` or ``new``, and with the rows of ``new``."""
    rest = old if gone is None else delete_keys(old, gone, keys)
    if new is None:
        return rest
    if keep:
        return upsert(rest, new, keys, keep)
    return replace_group(rest, new, keys)


class Store:
    """``buckets``: how many a table gets when it is written as a whole; tables that are there keep their number until then."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._open: dict[str, dict] | None = None
        self._file = Catalogue(spark, f"{self.root}/_CATALOGUE")
        self._path, self._fs = spark._jvm.org.apache.hadoop.fs.Path, self._file.fs

    def _catalogue(self) -> dict[str, dict]:
        """table -> {version, buckets, at}; ``at`` has a bucket's version, negative where it has been empty since then. A whole version
        without buckets, as stores had them once, is a mere number in the file."""
        read = self._file.read()
        return {t: x if isinstance(x, dict) else {"version": x, "buckets": 0, "at": {}} for t, x in read.items()}

    @contextmanager
    def together(self) -> Iterator[None]:
        """Writes inside become visible to other readers at the end, all at once; an error leaves everything as it was."""
        if self._open is not None:  # inside another one
            yield
            return
        self._open = self._catalogue()
        try:
            yield
            self._file.put(self._open)
        finally:
            self._open = None

    @contextmanager
    def writing(self) -> Iterator[None]:
        """Holds the lock of the store, for a whole sync. Writers of this process wait for each other; another process gets ``Busy``.

        The lock is a file that is made only where there is none and then names its maker. Changes renew its time; one that is
        older than ``STALE_SECONDS`` was left by a writer that died and is taken over.
        """
        with _HERE.setdefault(self.root, threading.RLock()):
            at, mine = self._path(f"{self.root}/_LOCK"), uuid.uuid4().hex
            if self._holds(at) is not None and time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 > STALE_SECONDS:
                self._fs.delete(at, False)
            if not self._claim(at, mine):
                raise Busy(f"{self.root} is being written by another sync; remove _LOCK there if that one has died")
            try:
                yield
            finally:
                if self._holds(at) == mine:
                    self._fs.delete(at, False)

    def _claim(self, at, mine: str) -> bool:
        self._make_root()
        try:
            stream = self._fs.create(at, False)
            stream.write(bytearray(mine.encode()))
            stream.close()
        except Exception:  # noqa: BLE001 - whatever the file system says when the file is there
            if self._holds(at) is None:
                raise
            return False
        return self._holds(at) == mine

    def _holds(self, at) -> str | None:
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _make_root(self) -> None:
        """The folder holds private texts: only its owner can open it."""
        at = self._path(self.root)
        if not self._fs.exists(at):
            hadoop = self.spark._jvm.org.apache.hadoop.fs
            hadoop.FileSystem.mkdirs(self._fs, at, hadoop.permission.FsPermission("700"))

    def _entry(self, table: str) -> dict:
        """What the catalogue says of a table; inside ``together`` what has been written there counts."""
        return (self._catalogue() if self._open is None else self._open).get(table, {"version": 0, "buckets": 0, "at": {}})

    def version(self, table: str) -> int:
        """0 before the first write."""
        return self._entry(table)["version"]

    def read(self, table: str) -> DataFrame:
        entry = self._entry(table)
        return self._rows(table, entry, range(entry["buckets"]))

    def _rows(self, table: str, entry: dict, buckets: Iterable[int]) -> DataFrame:
        at = [(b, entry["at"].get(str(b), 0)) for b in buckets]
        paths = [f"{self.root}/{table}/v{n}/bucket={b}" for b, n in at if n > 0]
        if entry["version"] and not entry["buckets"]:
            paths = [f"{self.root}/{table}/v{entry['version']}"]
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*paths)

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Writes the whole table as its next version and makes it the current one."""
        return self._put(table, df, {"version": self.version(table), "buckets": self.buckets, "at": {}}, range(self.buckets))

    def change(self, table: str, keys: list[str], new: DataFrame | None = None, gone: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Removes the rows that have keys of ``gone`` or ``new`` and adds those of ``new``; columns in ``keep`` stay as they were.

        ``keys`` must have the column that the table's buckets go by. Only buckets that these keys fall into are read and written.
        Both sides are computed twice, for their keys first: give staged ones where that is dear.
        """
        by, entry = BUCKET_KEYS.get(table, "uid"), self._entry(table)
        if by not in keys:
            raise ValueError(f"changes of {table} need its key {by}")
        if not entry["buckets"]:
            return self.write(table, changed(self.read(table), keys, new, gone, keep))
        hit = [x.select(_bucket(by, entry["buckets"]).alias("bucket")) for x in (new, gone) if x is not None]
        touched = hit[0] if len(hit) == 1 else hit[0].unionByName(hit[1])
        numbers = sorted(r["bucket"] for r in touched.distinct().collect())  # as many as there are buckets at most
        if not numbers:
            return self.read(table)
        return self._put(table, changed(self._rows(table, entry, numbers), keys, new, gone, keep), entry, numbers)

    def _put(self, table: str, df: DataFrame, entry: dict, buckets: Iterable[int]) -> DataFrame:
        """Writes some buckets as the next version. Rows are balanced by bucket, large buckets as several files."""
        self._make_root()
        n = max([entry["version"], *self._known(table)]) + 1
        kinds = self.spark.createDataFrame([], TABLES[table]).schema
        rows = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds))
        rows = rows.withColumn("bucket", _bucket(BUCKET_KEYS.get(table, "uid"), entry["buckets"])).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{table}/v{n}")
        filled = self._in(table, n)
        at = {**entry["at"], **{str(b): n if b in filled else -n for b in buckets}}
        made = {"version": n, "buckets": entry["buckets"], "at": at}
        if self._open is None:
            self._file.put({**self._catalogue(), table: made})
        else:
            self._open[table] = made
        lock = self._path(f"{self.root}/_LOCK")
        if self._fs.exists(lock):
            self._fs.setTimes(lock, int(time.time() * 1000), -1)
        return self.read(table)

    def _known(self, table: str) -> list[int]:
        """Versions that lie there, also those of changes that came to nothing."""
        return [int(n[1:]) for n in self._file.names(f"{self.root}/{table}") if n[:1] == "v" and n[1:].isdigit()]

    def _in(self, table: str, n: int) -> set[int]:
        """Buckets that have files of a version."""
        return {int(x[7:]) for x in self._file.names(f"{self.root}/{table}/v{n}") if x.startswith("bucket=")}

    def stage(self, df: DataFrame) -> DataFrame:
        """The same rows written aside and read again, so that plans stay short and nothing is computed twice."""
        path = f"{self.root}/_staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_stages(self) -> None:
        self._fs.delete(self._path(f"{self.root}/_staging"), True)

    def vacuum(self, keep: int = 2) -> None:
        """Removes what no bucket has been of for the last ``keep`` versions of its table, up to the current one."""
        for table in TABLES:
            entry = self._entry(table)
            lies = {n: self._in(table, n) for n in self._known(table)}
            for n, held in lies.items():
                replaced = {b for b in held if entry["at"].get(str(b)) != n and self._next(b, n, lies, entry) <= entry["version"] - keep + 1}
                if n <= entry["version"] - keep and replaced == held and (entry["buckets"] or n < entry["version"]):
                    self._file.remove(f"{self.root}/{table}/v{n}")
                else:
                    for b in replaced:
                        self._file.remove(f"{self.root}/{table}/v{n}/bucket={b}")

    @staticmethod
    def _next(b: int, n: int, lies: dict[int, set[int]], entry: dict) -> int:
        """The version that a bucket was written anew, or emptied, in after version ``n``."""
        later = [m for m, held in lies.items() if m > n and b in held] + [abs(entry["at"].get(str(b), entry["version"]))]
        return min([m for m in later if m > n], default=n)

    def clear(self, provider: str | None = None) -> None:
        """Forgets everything but the vector caches, or all that one provider's files gave."""
        with self.together():
            if provider is None:
                for table in TABLES:
                    if not table.endswith("_cache"):
                        self.write(table, self.spark.createDataFrame([], TABLES[table]))
                return
            gone = self.read("sessions").filter(F.col("provider") == provider).select("uid")
            for table in ("chunk_embeddings", "chunks", "session_sources", "session_docs", "sessions"):
                self.change(table, ["uid"], gone=gone)
            for table in ("parse_errors", "sources"):
                self.change(table, ["path"], gone=self.read(table).filter(F.col("provider").eqNullSafe(provider)))

    def status(self) -> DataFrame:
        """One row: sessions, vectors, and chunks by status."""
        sessions = self.read("sessions").agg(F.count("*").alias("sessions"))
        vectors = self.read("chunk_embeddings").agg(F.count("*").alias("vectors"))
        errors = self.read("parse_errors").agg(F.count("*").alias("parse_errors"))
        return sessions.crossJoin(vectors).crossJoin(errors).crossJoin(status_counts(self.read("chunks")))

    def recent_sources(self, limit: int = 20) -> DataFrame:
        return self.read("sources").orderBy(F.desc("last_seen_at"), "path").limit(max(1, limit))

    def recent_errors(self, limit: int = 20) -> DataFrame:
        return self.read("parse_errors").orderBy(F.desc("updated_at"), "path").limit(max(1, limit))
