"""A lexical index that follows its documents: segments of posting lists, tombstones, and merges of segments of like size.

A refresh compares digests of the documents with those that were indexed, makes the words of new and changed documents, and writes their lists as one more
segment. What an older segment has of a changed or lost document stays there with a tombstone, until that segment is merged: segments
whose sizes are within a factor are merged when there are as many, and one that is mostly tombstones is written anew, both from its
lists and without a text being read. Numbers of documents and words add up over segments, so scores are those of an index made at once.

    _SEGMENTS           the catalogue: segments with their numbers, and the versions of the two tables below
    segment=N/          (doc, field, term, n, positions) in order of term
    live/vN             (doc, segment, n_tokens, digest) of each document that is indexed
    dead/vN             (doc, segment) of what segments hold in vain
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.tokens import plain_tokens, stemmed_tokens
from threadloom.operators.lexical import Index, build_index, sort_lists, write_lists

#: Segments of like size that are merged, and by how much sizes of one tier differ.
FACTOR = 4


class Catalogue:
    """A small file of JSON that readers see whole, in its old or its new state."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._at, self._folder = self._path(path), path.rpartition("/")[0]
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self.fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self) -> dict:
        if not self.fs.exists(self._at):
            return {}
        stream = self.fs.open(self._at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, value: dict) -> None:
        """The new file takes the old one's place by a rename, so that there is one at any time."""
        aside = self._path(f"{self._folder}/.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        if not self.fs.rename(aside, self._at):  # file systems that rename over a file only when told so
            self._over(aside)

    def _over(self, aside) -> None:
        hadoop = self._jvm.org.apache.hadoop.fs
        kinds = self._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        kinds[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(aside, self._at, kinds)

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        at = self._path(path)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []


class SegmentedIndex:
    """``fields``: text column -> weight, as for ``build_index``. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, fields: dict[str, float], stemmed: bool = True, factor: int = FACTOR):
        self.spark, self.root, self.fields, self.stemmed, self.factor = spark, root.rstrip("/"), dict(fields), stemmed, factor
        self.catalogue = Catalogue(spark, f"{self.root}/_SEGMENTS")

    def state(self) -> dict:
        """segments: number -> {docs, tokens, written}, docs and tokens being those that live; live, dead: versions; of: what the caller named last."""
        return {"segments": {}, "live": 0, "dead": 0, "next": 1, "of": None, "doc": "string"} | self.catalogue.read()

    def _table(self, name: str, state: dict) -> DataFrame:
        kind = f"doc {state['doc']}, segment int" + ", n_tokens long, digest string" * (name == "live")
        if not state[name]:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.root}/{name}/v{state[name]}")

    def _lists(self, state: dict, numbers: list[int]) -> DataFrame:
        """The lists of some segments without what is dead in them."""
        kind = f"doc {state['doc']}, field string, term string, n int, positions array<int>, segment int"
        if not numbers:
            return self.spark.createDataFrame([], kind)
        found = self.spark.read.schema(kind).option("basePath", self.root).parquet(*(f"{self.root}/segment={n}" for n in numbers))
        if all(state["segments"][str(n)]["docs"] == state["segments"][str(n)]["written"] for n in numbers):
            return found
        return found.join(self._table("dead", state).filter(F.col("segment").isin(numbers)), ["doc", "segment"], "left_anti")

    def refresh(self, docs: DataFrame, id_col: str, of: object = None) -> dict:
        """Brings the index up to ``docs``, whose ids are unique and not null. Returns {added, removed, merged}: documents whose words were made anew,
        documents that lost an older version, and segments that went into others. ``of`` names the state of the documents for later callers."""
        state = self.state()
        before = {k: v for k, v in state.items() if k != "before"}
        state["doc"] = docs.schema[id_col].dataType.simpleString()
        own = docs.select(F.col(id_col).alias("doc"), *self.fields)
        digest = F.sha2(F.to_json(F.struct(*(F.col(f).cast("string").alias(f) for f in self.fields))), 256).alias("digest")
        live = self._table("live", state)
        both = own.select("doc", digest).join(live.select("doc", F.col("digest").alias("was"), "segment"), "doc", "full_outer")
        moved = self._aside(both.filter(~F.col("digest").eqNullSafe(F.col("was"))), "moved")
        told = moved.agg(F.count("digest").alias("added"), F.count("was").alias("removed")).first()
        out = {"added": told["added"], "removed": told["removed"], "merged": 0}
        if out["added"] or out["removed"]:
            live = live.join(moved.select("doc"), "doc", "left_anti")
            dead = self._table("dead", state).unionByName(moved.filter("was is not null").select("doc", "segment"))
            if out["added"]:
                number = state["next"]
                state["next"] += 1
                new = moved.filter("digest is not null").select("doc", "digest")
                made = build_index(own.join(new, "doc", "left_semi"), "doc", self.fields, self.stemmed)
                texts = self._aside(made.texts, "texts")
                write_lists(texts, f"{self.root}/segment={number}")
                sizes = texts.groupBy("doc").agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("n_tokens"))
                live = live.unionByName(new.join(sizes, "doc").select("doc", F.lit(number).alias("segment"), "n_tokens", "digest"))
                state["segments"][str(number)] = {"written": out["added"]}
            self._write(state, live, dead)
            out["merged"] = self._merge(state)
            state["before"] = json.loads(json.dumps(before))
        state["of"] = of
        self.catalogue.put(state)
        self._sweep(state)
        return out

    def _aside(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/_aside/{uuid.uuid4().hex}-{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _write(self, state: dict, live: DataFrame, dead: DataFrame) -> None:
        """The next versions of both tables, and what lives of each segment; segments of which nothing lives go with their tombstones."""
        version = max(state["live"], state["dead"]) + 1
        live.write.mode("overwrite").parquet(f"{self.root}/live/v{version}")
        state["live"] = version
        found = {r["segment"]: r for r in self._table("live", state).groupBy("segment").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}
        state["segments"] = {n: {"written": s["written"], "docs": found[int(n)]["docs"], "tokens": found[int(n)]["tokens"]} for n, s in state["segments"].items() if int(n) in found}
        dead.filter(F.col("segment").isin([int(n) for n in state["segments"]])).write.mode("overwrite").parquet(f"{self.root}/dead/v{version}")
        state["dead"] = version

    def _merge(self, state: dict) -> int:
        """Merges segments of one tier while there are as many as the factor, and rewrites those that are mostly dead."""
        merged = 0
        while True:
            tiers: dict[int, list[int]] = {}
            for n, s in state["segments"].items():
                tiers.setdefault(int(math.log(s["docs"], self.factor) + 1e-9), []).append(int(n))
            full = next((sorted(t) for _, t in sorted(tiers.items()) if len(t) >= self.factor), None)
            full = full or next(([int(n)] for n, s in state["segments"].items() if 2 * s["docs"] < s["written"]), None)
            if not full:
                return merged
            number = state["next"]
            state["next"] += 1
            sort_lists(self._lists(state, full).drop("segment")).write.mode("overwrite").parquet(f"{self.root}/segment={number}")
            live, dead = self._table("live", state), self._table("dead", state).filter(~F.col("segment").isin(full))
            kept = sum(state["segments"].pop(str(n))["docs"] for n in full)
            state["segments"][str(number)] = {"written": kept}
            self._write(state, live.withColumn("segment", F.when(F.col("segment").isin(full), F.lit(number)).otherwise(F.col("segment"))), dead)
            merged += len(full)

    def _sweep(self, state: dict) -> None:
        """Removes what neither this state nor the one before it names: searches that began before this refresh can end."""
        held = [state, *([state["before"]] if "before" in state else [])]
        names = {f"segment={n}" for s in held for n in s["segments"]}
        for name in self.catalogue.names(self.root):
            if name.startswith("segment=") and name not in names or name == "_aside":
                self.catalogue.remove(f"{self.root}/{name}")
        for table in ("live", "dead"):
            for name in self.catalogue.names(f"{self.root}/{table}"):
                if name not in {f"v{s[table]}" for s in held}:
                    self.catalogue.remove(f"{self.root}/{table}/{name}")

    def index(self) -> Index:
        """The index as of the last refresh."""
        state = self.state()
        numbers = sorted(map(int, state["segments"]))
        docs, tokens = (sum(s[k] or 0 for s in state["segments"].values()) for k in ("docs", "tokens"))
        lengths = self._table("live", state).select("doc", "n_tokens")
        make = stemmed_tokens if self.stemmed else plain_tokens
        return Index(lengths, self.fields, make, stored=self._lists(state, numbers).drop("segment"), totals=(docs, tokens))
