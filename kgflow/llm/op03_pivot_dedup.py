"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest reference points in order.  Similar vectors share
many of them, so each vector enters the inverted lists of its rarest ones, as many as it
takes for two vectors with SHARED pivots in common to meet (of k pivots, the k - SHARED + 1
with the shortest lists).  A list is dealt into blocks, every block meets every other, and
all cosines of two blocks are computed: nothing in a list is left out, however long it is.
What two similar vectors can lose is the list itself; see the measured recall.

Equal vectors of a label are one node throughout, named by a 128-bit print.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from kgflow.llm.common import Scratch, connected_components, join_groups, lean, sorted_groups, table

THRESHOLD = 0.93
#: Reference points, a vector in so many; they are the distinct vectors with the smallest prints, so dense regions have more.
ROWS_A_PIVOT = 64
FEWEST_PIVOTS, MOST_PIVOTS = 256, 2048
#: Fewest reference points of a dimension.
LEAST = 32
#: Pivots that describe a vector, and how many of them two vectors must share to be sure to meet.
LENGTH, SHARED = 16, 6
#: Vectors of a list in a block.
BLOCK = 256


def _unit(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, "<f8")
    return v / np.linalg.norm(v)


def _valid_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding): adds the vector in double precision and a print of label and vector, or nulls where it can link with nothing."""
    for batch in batches:
        vs, h1, h2 = [], [], []
        for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            ok = label is not None and v and None not in v
            a = np.array(v, "<f8") if ok else None
            ok = ok and np.isfinite(a).all() and a.any()
            if ok and not 1e-150 < np.linalg.norm(a) < 1e150:  # its square would over- or underflow: a power of two less changes no cosine
                a = np.ldexp(a, -np.frexp(np.abs(a).max())[1])
            vs.append(a.tobytes() if ok else None)
            one, two = np.frombuffer(xxh3_128_digest(a.tobytes() + label.encode()), "<i8").tolist() if ok else (None, None)
            h1.append(one)
            h2.append(two)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(vs, pa.binary()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["vec_id", "label", "v", "node", "check"])


def reference_points(sample: list[bytes]) -> dict[int, np.ndarray]:
    """Pivots by dimension."""
    out: dict[int, list] = {}
    for raw in sample:
        out.setdefault(len(raw) // 8, []).append(_unit(raw))
    return {d: np.array(rows) for d, rows in out.items()}


def _pivots_for(points: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The pivots of a dimension; one with few sampled vectors gets random directions besides."""
    have = points.get(dim, np.zeros((0, dim)))
    if len(have) < LEAST:
        more = np.random.default_rng(dim).normal(size=(LEAST - len(have), dim))
        have = points[dim] = np.concatenate([have, more / np.linalg.norm(more, axis=1, keepdims=True)])
    return have


def permutation(x: np.ndarray, pivots: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of unit vectors, the numbers of the nearest pivots, nearest first."""
    cosines = x @ pivots.T
    length = min(length, len(pivots))
    near = np.argpartition(-cosines, length - 1, axis=1)[:, :length]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(cosines, near, 1), axis=1, kind="stable"), 1)


def _permutations(points: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points_here = dict(points)
        for pdf in batches:
            for dim, g in pdf.groupby(pdf["v"].map(len) // 8, sort=False):
                order = permutation(np.stack([_unit(r) for r in g["v"]]), _pivots_for(points_here, dim))
                yield g.assign(dim=dim, pivots=list(order.astype(np.int32)))

    return run


def _index(lengths: dict[tuple[int, int], int], shared: int):
    """A row for each list that a vector enters: the rarest of its pivots, in the order of rarity that all vectors agree on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = [sorted(p.tolist(), key=lambda q, d=d: (lengths.get((d, q), 0), q)) for p, d in zip(pdf["pivots"], pdf["dim"].tolist(), strict=True)]
            lists = [x[: max(1, len(x) - shared + 1)] for x in lists]
            yield pdf.drop(columns="pivots").assign(lists=lists, pivot=lists).explode("pivot").astype({"pivot": "int32"})

    return run


def _roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows and of columns, the first row of their component, or -1 without a link."""
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    of_row, of_col = np.full(len(rows), -1), np.full(len(cols), -1)
    for s in np.flatnonzero(rows).tolist():
        new = np.array([s] if rows[s] else [], int)
        while len(new):
            rows[new], of_row[new] = False, s
            met = np.flatnonzero(cols & linked[new].any(axis=0))
            cols[met], of_col[met] = False, s
            new = np.flatnonzero(rows & linked[:, met].any(axis=1))
    return of_row, of_col


def _first_met(rows: np.ndarray, cols: np.ndarray, pivot: int) -> np.ndarray:
    """Whether pairs of lists, each in order of rarity, have ``pivot`` as the first that both hold."""
    mine, theirs = np.arange(rows.shape[1]) < (rows == pivot).argmax(axis=1)[:, None], np.arange(cols.shape[1]) < (cols == pivot).argmax(axis=1)[:, None]
    return ~((rows[:, :, None] == cols[:, None, :]) & mine[:, :, None] & theirs[:, None, :]).any(axis=(1, 2))


def _compare_tiles(threshold: float):
    """Tiles of a list, block i against block j: how many rows each vector links with there, and a vector of its component.

    Two vectors that meet in several lists are counted in the first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, ["label", "dim", "pivot", "i", "j"]):
            i, j, pivot = int(g["i"].iloc[0]), int(g["j"].iloc[0]), int(g["pivot"].iloc[0])
            x, nodes, own, n = np.stack([_unit(r) for r in g["v"]]), g["node"].to_numpy(), g["own"].to_numpy(), g["n"].to_numpy()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            linked = x[left] @ x[right].T >= threshold
            if i == j:
                np.fill_diagonal(linked, False)
            r, c = np.nonzero(linked)
            if not len(r):
                continue
            lists, counted = np.stack(g["lists"].to_list()), np.zeros(linked.shape)
            for at in range(0, len(r), 1 << 16):
                rr, cc = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
                counted[rr, cc] = _first_met(lists[left[rr]], lists[right[cc]], pivot)
            if i == j:
                joined = linked | linked.T
                np.fill_diagonal(joined, joined.any(axis=1))
                sides = [(left, counted @ n[right], _roots(joined)[0])]
            else:
                of_left, of_right = _roots(linked)
                sides = [(left, counted @ n[right], of_left), (right, counted.T @ n[left], of_right)]
            for at, links, root in sides:
                has = root >= 0
                yield pd.DataFrame({"node": nodes[at[has]], "links": links[has], "root": nodes[left[root[has]]]}, dtype="int64")

    return run


def pivot_dedup(vectors: DataFrame, threshold: float = THRESHOLD, pivots: int | None = None, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding, label, ...).

    Vectors link when their labels are equal, not null, and their cosine in double
    precision is at least ``threshold``.  A vector that is null, empty, zero or holds
    null or non-finite components links with nothing, nor do vectors of different
    length.  Equal vectors are compared once and count each.  Rows that repeat a vec_id
    are vectors of their own and come out once each.  A row with a null vec_id lends no
    id to its component.  An empty table gives an empty one; other columns do not matter.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = source.mapInArrow(_valid_rows, "vec_id long, label string, v binary, node long, check long")
    with Scratch(spark) as scratch:
        ids = scratch.write(rows.select("vec_id", "node", "check"), "pivot-ids")
        classes = rows.where("node IS NOT NULL").groupBy("node", "check", "label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
        classes = scratch.write(classes, "pivot-classes")
        pivots = pivots or min(MOST_PIVOTS, max(FEWEST_PIVOTS, classes.count() // ROWS_A_PIVOT))
        sample = classes.orderBy("node", "check").select("v").limit(pivots)
        points = reference_points([bytes(r.v) for r in sample.collect()])  # at most MOST_PIVOTS vectors
        described = classes.select("node", "label", "v", "n").mapInPandas(lean(_permutations(points)), "node long, label string, v binary, n long, dim int, pivots array<int>")
        described = scratch.write(described, "pivot-permutations")
        # how often a pivot is near: of dimensions that the sample has, so the pivots bound what the driver gets
        held = described.where(F.col("dim").isin([*points])).select("dim", F.explode("pivots").alias("pivot")).groupBy("dim", "pivot").count()
        lengths = {(r.dim, r.pivot): r[2] for r in held.collect()}
        index = described.mapInPandas(lean(_index(lengths, shared)), "node long, label string, v binary, n long, dim int, lists array<int>, pivot int")
        sizes = index.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        sizes = scratch.write(sizes, "pivot-lists")
        members = index.join(sizes, ["label", "dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        tiles = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiles = tiles.select("label", "dim", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "v", "n", "lists")
        tiles = tiles.repartition("label", "dim", "pivot", "i", "j").sortWithinPartitions("label", "dim", "pivot", "i", "j")
        met = scratch.write(tiles.mapInPandas(lean(_compare_tiles(threshold)), "node long, links long, root long"), "pivot-links")
        found = connected_components(met, "node", "root", scratch)
        counts = met.groupBy("node").agg(F.sum("links").alias("links"))
        known = classes.select("node", "check", "rep", "n").join(found, "node", "left").join(counts, "node", "left")
        known = scratch.write(known.select("node", "check", "rep", "n", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "pivot-known")
        groups = known.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1")
        answers = scratch.write(known.join(groups, "component").select("node", "check", "n", "links", "component_id"), "pivot-answers")
        component = F.coalesce("component_id", "vec_id")
        return scratch.keep(
            join_groups(ids, answers, ["node", "check"], "n").select(
                "vec_id",
                F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
                component.alias("component_id"),
                F.col("vec_id").eqNullSafe(component).alias("kept"),
            ),
            "pivot-result",
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup(table(spark, sf_dir, "embeddings"))
