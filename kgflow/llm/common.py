"""What the operators of this subpackage share: tables, scratch space, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the sense of the contracts: space and the ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def sql_ascii_lower(expr: str) -> str:
    return f"translate({expr}, '{_UPPER}', '{_UPPER.lower()}')"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared folder of the session (spark.checkpoint.dir).

    Where that setting is missing the warehouse serves a cluster, and a temporary
    folder serves local mode, in which all tasks share this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            root = tempfile.mkdtemp(prefix="spark-kgflow-")
            spark.conf.set("spark.checkpoint.dir", root)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The rows of df as a Parquet table in shared scratch space: cuts lineage, survives lost executors.

    The shuffle files that the write needed go when it is done, since nothing reads them again.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, tag), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """The scratch tables of one operator call: what is not kept is deleted when the block ends, or as soon as it is dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}  # path: its table, or the name of one in the catalog

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """df as a table that goes with this scope."""
        out, path = written(df, tag)
        self.paths[path] = out
        return out

    def own(self, path: str, table: str) -> None:
        """Takes over a catalog table that lies at path."""
        self.paths[path] = table

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """df as a table that outlives this scope, for results that are read later."""
        return written(df, tag)[0]

    def drop(self, *tables: DataFrame | str) -> None:
        """Deletes tables, given as what ``write`` gave or by path, whose readers are written."""
        for t in tables:
            path = t if isinstance(t, str) else next(p for p, x in self.paths.items() if x is t)
            if isinstance(held := self.paths.pop(path), str):
                self.spark.sql(f"DROP TABLE IF EXISTS {held}")
            drop_path(self.spark, path)


#: A group of more rows than this share of all is hot; there are at most as many hot groups as its inverse.
HOT_SHARE = 1 / 1000
_SPREAD = 1024


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows left-joined with groups (keys, n = number of rows, ...) where one group may hold a third of all rows.

    Hot groups are 1,000 rows at most by their definition, so they are broadcast; rows of
    the others, of which none is hot, meet them by key.  Keys are not null in ``groups``,
    and a row with a null key meets none.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    least = total * HOT_SHARE
    values = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(n) > least).select(*keys, F.struct(*values).alias("__hot"))
    cold = groups.where(F.col(n) <= least).select(*keys, F.lit(0).alias("__salt"), F.struct(*values).alias("__cold"))
    out = rows.join(F.broadcast(hot), keys, "left")
    # rows that have met their group, or can meet none, are spread over salts of their own, where nothing waits for them
    done = F.col("__hot").isNotNull()
    for k in keys:
        done = done | F.col(k).isNull()
    spread = F.when(~done, 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(_SPREAD))).cast("int")
    out = out.withColumn("__salt", spread).hint("merge").join(cold, [*keys, "__salt"], "left")
    return out.select(*rows.columns, *[F.coalesce(f"__hot.{v}", f"__cold.{v}").alias(v) for v in values])


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of a sieve: 16 for each key as far as the most allow.  Beyond that it lets more pass, and stays as large.
_SIEVE_LEAST, _SIEVE_MOST, _SIEVE_CHUNKS = 1 << 16, 1 << 27, 256


def _sieve_places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix64(keys.astype(np.int64).view(np.uint64))
    return np.concatenate([h, h >> np.uint64(32)]).astype(np.int64) & (bits - 1)


class Sieve:
    """A Bloom filter of the longs in ``keys``, a table of one column: all of them pass, and few others.

    It has 16 MB at most, whatever the number of keys, so it can go to every task; what it keeps back need not be
    shuffled to be joined.  What passes still has to meet the keys themselves.
    """

    def __init__(self, keys: DataFrame):
        n, spark = keys.count(), keys.sparkSession
        self.bits = bits = min(_SIEVE_MOST, max(_SIEVE_LEAST, 1 << (16 * n).bit_length()))
        chunk, (name,) = bits // _SIEVE_CHUNKS, keys.columns

        def places(batches):
            for pdf in batches:
                p = distinct(_sieve_places(pdf[name].to_numpy(), bits))
                yield pd.DataFrame({"chunk": p // chunk, "place": p % chunk})

        def fill(g: pd.DataFrame) -> pd.DataFrame:
            held = np.zeros(chunk, bool)
            held[g["place"].to_numpy()] = True
            return pd.DataFrame({"chunk": g["chunk"].iloc[:1], "held": [np.packbits(held, bitorder="little").tobytes()]})

        full = bytearray(bits // 8)
        for row in keys.mapInPandas(places, "chunk long, place long").groupBy("chunk").applyInPandas(fill, "chunk long, held binary").collect():
            full[row.chunk * chunk // 8 : (row.chunk + 1) * chunk // 8] = row.held
        self.held = spark.sparkContext.broadcast(np.frombuffer(bytes(full), np.uint8))

    def __getstate__(self) -> tuple:
        return self.bits, self.held

    def __setstate__(self, state: tuple) -> None:
        self.bits, self.held = state

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Which of the longs pass; in tasks."""
        p, held = _sieve_places(keys, self.bits), self.held.value
        hit = (held[p >> 3] >> (p & 7).astype(np.uint8)) & 1
        return (hit[: len(keys)] & hit[len(keys) :]).astype(bool)

    def column(self, key: Column) -> Column:
        """Whether a long that is not null passes."""
        return F.pandas_udf(lambda keys: pd.Series(self.passes(keys.to_numpy())), "boolean")(key)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; on short arrays several times as fast as numpy.unique."""
    x = np.sort(x)
    first = np.empty(len(x), bool)
    first[:1] = True
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def lean(work):
    """work(batches) that gives memory back when it ends, since Spark keeps its Python workers for the next stage."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def sorted_groups(batches, keys: list[str]):
    """The groups of a partition that is sorted by the keys, each whole."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        while len(pdf):
            key = pdf[keys].iloc[0]
            if held and not (held[0][keys].iloc[0] == key).all():
                yield pd.concat(held, ignore_index=True)
                held = []
            changes = np.flatnonzero((pdf[keys] != key).any(axis=1).to_numpy())
            cut = int(changes[0]) if len(changes) else len(pdf)
            held.append(pdf.iloc[:cut])
            pdf = pdf.iloc[cut:]
    if held:
        yield pd.concat(held, ignore_index=True)


def _local_forest(batches):
    """Union-find over the edges of one partition; gives (child, parent) to each node's smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for pdf in batches:
        for a, b in zip(pdf["child"].tolist(), pdf["parent"].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                lo, hi = (ra, rb) if ra < rb else (rb, ra)
                parent[hi] = lo
                parent.setdefault(lo, lo)
    rows = [(x, find(x)) for x in list(parent)]
    rows = [r for r in rows if r[0] != r[1]]
    yield pd.DataFrame(rows, columns=["child", "parent"]).astype("int64")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """Components of an undirected graph given by its edges: rows (node, component), component the smallest node.

    Only nodes that have an edge to another node appear.  A distributed union-find:
    every partition contracts its own edges, then rounds over tables link all parents
    of a child to the smallest of them until each child has one parent, and pointer
    jumping flattens the trees.  Edges point from larger to smaller nodes, so a hub
    that many nodes share is a parent; its rows meet in a join that Spark can split.
    Each round is a written table, so nothing gathers on the driver or in one task;
    the last one belongs to ``scratch`` and stays where none is given.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark)
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("child"), F.least(a, b).cast("long").alias("parent"))
    forest = scratch.write(pairs.mapInPandas(lean(_local_forest), "child long, parent long").distinct(), "cc")
    while True:
        least = forest.groupBy("child").agg(F.min("parent").alias("least"), F.count("*").alias("n"))
        if least.where("n > 1").isEmpty():
            break
        hung = forest.join(least.where("n > 1"), "child").where("parent <> least")
        nxt = least.select("child", F.col("least").alias("parent")).union(hung.select(F.col("parent").alias("child"), F.col("least").alias("parent"))).distinct()
        old, forest = forest, scratch.write(nxt, "cc")
        scratch.drop(old)
    while True:
        up = forest.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        jumped = forest.select("child", "parent").join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        old, forest = forest, scratch.write(jumped, "cc")
        scratch.drop(old)
        if forest.where("moved").isEmpty():
            break
    return forest.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(forest.select(F.col("parent"), F.col("parent")).distinct())
