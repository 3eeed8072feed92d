"""A table of rows by key: snapshots that name files by bucket, upserts as deltas, compaction of what they touched."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgflow.sources.manifest import Manifest


class KeyedTable:
    """Rows by ``keys`` below a folder; of each key the row of the highest ``ord`` counts, among equal ones the later upsert's.

    A snapshot is an entry of a manifest: for every bucket of keys its compacted files and the deltas since.  An upsert
    writes the buckets that it touches and puts the next snapshot in place, so readers see all of it or nothing, and
    files of other buckets stay as they are.  Numbered batches of a stream count once.  ``buckets`` belongs to the
    table's first snapshot; later ones follow that.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self.manifest, self.buckets = Manifest(spark, f"{self.root}/manifest"), buckets
        self._stored = StructType(self.schema.fields).add("__upsert", "long")

    def _snapshot(self) -> dict:
        held = self.manifest.last()[1] or {"buckets": self.buckets, "files": {}, "batches": {}, "upserts": 0}
        self.buckets = held["buckets"]
        return held

    def bucket_of(self, *keys: str) -> Column:
        """The bucket of the key that these columns hold; they have the key columns' types."""
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str) -> tuple[str, list[str]]:
        """Writes rows by bucket: the folder, and the buckets that have rows."""
        folder = f"{kind}/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self.bucket_of(*self.keys)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        fs = self.manifest._fs()
        names = [s.getPath().getName() for s in fs.listStatus(self.manifest._hadoop.Path(f"{self.root}/{folder}"))]
        return folder, [n.removeprefix("bucket=") for n in names if n.startswith("bucket=")]

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct("ord", "__upsert")).alias("row")).select(*self.keys, "row.*").select(*rows.columns)

    def upsert(self, changes: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """Applies changes (columns as in the schema, ``ord`` among them); False if the stream's batch has been applied."""
        held = self._snapshot()
        if batch is not None and held["batches"].get(stream, -1) >= batch:
            return False
        number = held["upserts"] + 1
        folder, touched = self._write(self._latest(changes.select(*self.schema.names).withColumn("__upsert", F.lit(number).cast("long"))), "deltas")

        def add(last: dict | None) -> dict | None:
            now = last or held
            if batch is not None and now["batches"].get(stream, -1) >= batch:
                return None
            files = {b: [*now["files"].get(b, []), f"{folder}/bucket={b}"] for b in touched}
            batches = now["batches"] | ({stream: batch} if batch is not None else {})
            return {"buckets": now["buckets"], "files": now["files"] | files, "batches": batches, "upserts": max(now["upserts"], number)}

        if self.manifest.changed(add) is None:
            self.manifest._fs().delete(self.manifest._hadoop.Path(f"{self.root}/{folder}"), True)
            return False
        return True

    def _rows(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(*[f"{self.root}/{f}" for f in files]) if files else self.spark.createDataFrame([], self._stored)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The current rows, of all or some buckets.  Only buckets with deltas are merged."""
        files = {b: f for b, f in self._snapshot()["files"].items() if buckets is None or int(b) in buckets}
        single = [f[0] for f in files.values() if len(f) == 1]
        merged = [x for f in files.values() if len(f) > 1 for x in f]
        rows = self._rows(single) if single or not merged else None
        if merged:
            rows = self._latest(self._rows(merged)) if rows is None else rows.union(self._latest(self._rows(merged)))
        return rows.select(*self.schema.names)

    def compact(self, most: int = 8) -> list[int]:
        """Rewrites the buckets that have more than ``most`` files, each as one; gives their numbers.

        Old files stay for readers of older snapshots; ``vacuum`` deletes them.  A bucket that another driver has
        compacted meanwhile keeps that driver's file.
        """
        before = self._snapshot()
        full = {b: f for b, f in before["files"].items() if len(f) > most}
        if not full:
            return []
        folder, _ = self._write(self._latest(self._rows([x for f in full.values() for x in f])), "compacted")

        def swap(last: dict) -> dict:
            done = {b: [f"{folder}/bucket={b}", *last["files"][b][len(f) :]] for b, f in full.items() if last["files"][b][: len(f)] == f}
            return last | {"files": last["files"] | done}

        self.manifest.changed(swap)
        return sorted(map(int, full))

    def vacuum(self) -> None:
        """Deletes older snapshots and the files that the current one does not name; no upsert or reader may be under way."""
        self.manifest.prune()
        used = {x for f in self._snapshot()["files"].values() for x in f}
        fs, path = self.manifest._fs(), self.manifest._hadoop.Path
        for kind in ("deltas", "compacted"):
            for folder in fs.listStatus(path(f"{self.root}/{kind}")) if fs.exists(path(f"{self.root}/{kind}")) else []:
                for part in fs.listStatus(folder.getPath()):
                    name = f"{kind}/{folder.getPath().getName()}/{part.getPath().getName()}"
                    if part.isDirectory() and name not in used:
                        fs.delete(part.getPath(), True)


class GraphStore:
    """Nodes and edges as keyed tables; nodes go first, and an edge whose ends are no nodes is told among the rejects."""

    def __init__(self, spark: SparkSession, root: str, nodes: StructType | str, edges: StructType | str, buckets: int = 64):
        self.nodes = KeyedTable(spark, f"{root}/nodes", nodes, ["node_id"], buckets)
        self.edges = KeyedTable(spark, f"{root}/edges", edges, ["head", "relation_type", "tail"], buckets)
        self.rejects = KeyedTable(spark, f"{root}/rejects", edges, ["head", "relation_type", "tail"], buckets)

    def upsert(self, nodes: DataFrame, edges: DataFrame, stream: str = "", batch: int | None = None) -> None:
        """One batch.  Ends are looked up in the buckets of nodes that they fall into.

        A rejected edge stays among the rejects; where a later batch brings the edge again, with its ends there by
        then, it is an edge too.
        """
        self.nodes.upsert(nodes, stream, batch)
        self.nodes._snapshot()
        ends = edges.select(F.explode(F.array("head", "tail")).alias("node_id"))
        buckets = [r[0] for r in ends.select(self.nodes.bucket_of("node_id")).distinct().collect()]  # as many as the table has at most
        known = self.nodes.read(buckets).select("node_id")
        told = edges
        for end in ("head", "tail"):
            told = told.join(known.select(F.col("node_id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
        lost = F.col("__head").isNull() | F.col("__tail").isNull()
        self.edges.upsert(told.where(~lost).select(*edges.columns), stream, batch)
        self.rejects.upsert(told.where(lost).select(*edges.columns), stream, batch)

    def compact(self, most: int = 8) -> None:
        for t in (self.nodes, self.edges, self.rejects):
            t.compact(most)
