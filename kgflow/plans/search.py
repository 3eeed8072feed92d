"""Vector search with score fusion, for a whole table of queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgflow.functions.text import cosine
from kgflow.operators.joins import restrict_subgraph
from kgflow.plans.assoc import Association, associate_all
from kgflow.sources.scratch import written


def top_k(rows: DataFrame, by: str, score: str, k: int, tie: str) -> DataFrame:
    """The k best rows per group with their rank."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def check_vectors(rows: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose vector has ``dim`` numbers, the others)."""
    ok = F.coalesce(F.size(vector) == dim, F.lit(False))
    return rows.where(ok), rows.where(~ok)


#: Queries of 64 numbers that a task holds, and vectors of a category that pass by them, at most.
QUERY_BLOCK, VECTOR_BLOCK = 65_536, 131_072
#: Pairs from which on a category is dealt to several tasks.
PAIRS = 1 << 22
#: Queries and vectors whose similarities are one matrix.
_ROWS, _COLUMNS = 512, 4096
#: Similarities are rounded to so many digits before they are ordered, since a matrix product may differ in the last bits of equal vectors.
_DIGITS = 12


def _unit_rows(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), dim)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class _Nearest:
    """The k nearest so far of the queries of one block, while the vectors of a block pass by in the order of their ids."""

    def __init__(self, dim: int, threshold: float, k: int):
        self.dim, self.threshold, self.k, self.passed = dim, threshold, k, 0
        self.asks, self.held, self.names, self.q = [], [], [], None

    def ask(self, ids: pa.Array, vectors: pa.Array) -> None:
        self.asks.append(ids)
        self.held.append(_unit_rows(vectors, self.dim))

    def meet(self, ids: pa.Array, vectors: pa.Array) -> None:
        if self.q is None:
            self.q, self.held = np.concatenate(self.held) if self.held else np.zeros((0, self.dim)), []
            self.best, self.at = np.full((len(self.q), self.k), -np.inf), np.zeros((len(self.q), self.k), np.int64)
        if not len(self.q):
            return
        v = _unit_rows(vectors, self.dim)
        for i in range(0, len(self.q), _ROWS):
            for j in range(0, len(v), _COLUMNS):
                self._better(slice(i, i + _ROWS), self.q[i : i + _ROWS] @ v[j : j + _COLUMNS].T, self.passed + j)
        self.names.append(ids)
        self.passed += len(v)

    def _better(self, rows: slice, scores: np.ndarray, first: int) -> None:
        best, at, k, close = self.best[rows], self.at[rows], self.k, 10.0**-_DIGITS
        near = (scores > self.threshold) & (scores >= best[:, -1:] - close)
        if scores.shape[1] > k and np.count_nonzero(near) > 4 * near.shape[0] * k:  # only what is as near as the k-th is sorted
            near &= scores >= np.partition(np.where(near, scores, -np.inf), -k, axis=1)[:, -k, None] - close
        i, j = np.nonzero(near)
        if not len(i):
            return
        which = np.unique(i)
        row = np.concatenate([np.repeat(which, k), i])
        score, place = np.concatenate([best[which].ravel(), np.round(scores[i, j], _DIGITS)]), np.concatenate([at[which].ravel(), first + j])
        order = np.lexsort((place, -score, row))  # of a query the nearest first, of equals the smallest id
        row, score, place = row[order], score[order], place[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        best[which], at[which] = score[kept].reshape(-1, k), place[kept].reshape(-1, k)

    def found(self) -> Iterator[pa.RecordBatch]:
        if not self.asks or not self.passed:
            return
        i, j = np.nonzero(self.best > -np.inf)
        cols = [pa.concat_arrays(self.asks).take(pa.array(i)), pa.concat_arrays(self.names).take(pa.array(self.at[i, j])), pa.array(self.best[i, j])]
        yield pa.record_batch(cols, names=["query_id", "node_id", "similarity"])


def _nearest(on: str, threshold: float, k: int):
    """Rows in the order of their blocks, of a block the queries first and then the vectors by id: (query_id, node_id, similarity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = state = None
        for batch in batches:
            col = {name: batch.column(name) for name in batch.schema.names}
            parts = [col[on].dictionary_encode().indices.to_numpy(), *(col[c].to_numpy(zero_copy_only=False) for c in ("dim", "a", "b", "asks"))]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in parts], axis=0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if start == end:
                    continue
                at = tuple(col[c][start].as_py() for c in (on, "dim", "a", "b"))
                if at != block:
                    if state:
                        yield from state.found()
                    block, state = at, _Nearest(at[1], threshold, k)
                asks, vectors = col["asks"][start].as_py(), col["v"].slice(start, end - start)
                (state.ask if asks else state.meet)(col["query_id" if asks else "node_id"].slice(start, end - start), vectors)
        if state:
            yield from state.found()

    return run


def cosine_topk(queries: DataFrame, vectors: DataFrame, on: str, threshold: float = 0.6, k: int = 10) -> DataFrame:
    """queries(query_id, on, q), vectors(node_id, on, v): the k nearest of the same category above the threshold.

    A category is dealt into blocks of queries and of vectors, of which each meets each: about as many pairs of blocks
    as the tasks that its share of all pairs is worth.  A task holds the queries of its block with their k nearest, and
    the vectors pass by; so rows are sent as often as there are tasks to share the work, not once for every few
    thousand of the other side, and a hot category is many tasks.
    Vectors meet those of their own length only; NULL ones meet none, zero ones have similarity 0.
    """

    def dealt(rows: DataFrame, id_col: str, v: str, side: str) -> tuple[DataFrame, DataFrame]:
        numbers = F.col(v) if dict(rows.dtypes)[v] == "array<float>" else F.col(v).cast("array<double>")
        rows = rows.where(F.col(v).isNotNull() & F.col(on).isNotNull()).select(F.col(id_col).alias("id"), on, numbers.alias("v"), F.size(v).alias("dim"))
        return rows, rows.groupBy(on, "dim").agg(F.count("*").alias(side))

    (q, nq), (v, nv) = dealt(queries, "query_id", "q", "nq"), dealt(vectors, "node_id", "v", "nv")
    tasks, sizes = 4 * queries.sparkSession.sparkContext.defaultParallelism, nq.join(nv, [on, "dim"])
    pairs = F.col("nq").cast("double") * F.col("nv")
    share = F.least(F.ceil(pairs / PAIRS), F.ceil(tasks * pairs / sizes.agg(F.sum(pairs)).scalar()))
    # the blocks of both sides are about as long, so that the fewest rows are sent
    a = F.greatest(F.ceil(F.col("nq") * F.greatest(F.col("dim") / 64, F.lit(1.0)) / QUERY_BLOCK), F.least(F.col("nq"), F.round(F.sqrt(share * F.col("nq") / F.col("nv")))), F.lit(1))
    plan = sizes.withColumn("share", share).withColumn("a_n", a.cast("int"))
    b = F.greatest(F.ceil(F.col("nv") / VECTOR_BLOCK), F.least(F.col("nv"), F.ceil(F.col("share") / F.col("a_n"))), F.lit(1))
    plan = plan.withColumn("b_n", b.cast("int")).select(on, "dim", "a_n", "b_n")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    types = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["node_id"]
    q = q.join(plan, [on, "dim"]).select(on, "dim", "b_n", "v", F.lit(True).alias("asks"), own("a_n").alias("a"), each("b_n").alias("b"), F.col("id").alias("query_id"), F.lit(None).cast(types[1]).alias("node_id"))
    v = v.join(plan, [on, "dim"]).select(on, "dim", "b_n", "v", F.lit(False).alias("asks"), each("a_n").alias("a"), own("b_n").alias("b"), F.lit(None).cast(types[0]).alias("query_id"), F.col("id").alias("node_id"))
    task = F.pmod(F.pmod(F.xxhash64(on, "dim"), F.lit(tasks)) + F.col("a") * F.col("b_n") + F.col("b"), F.lit(tasks)).cast("int")
    rows = q.unionByName(v).repartitionById(tasks, task).drop("b_n")
    rows = rows.sortWithinPartitions(on, "dim", "a", "b", F.col("asks").desc(), "node_id")
    found = rows.mapInArrow(_nearest(on, threshold, k), f"query_id {types[0]}, node_id {types[1]}, similarity double")
    return top_k(found, "query_id", "similarity", k, "node_id")


def weight_gate(key: Column, semantic: Column, hidden: Sequence[Sequence[float]], out: Sequence[Sequence[float]]) -> Column:
    """struct(alpha, beta): softmax of a network with one hidden layer; rows are (weights ..., bias). NULL scores give halves."""
    h = [F.greatest(F.lit(0.0), key * a + semantic * b + c) for a, b, c in hidden]
    logits = []
    for row in out:
        total = F.lit(float(row[-1]))
        for x, w in zip(h, row, strict=False):
            total = total + x * w
        logits.append(total)
    top = F.greatest(*logits)
    e = [F.exp(x - top) for x in logits]
    alpha = F.coalesce(e[0] / (e[0] + e[1]), F.lit(0.5))
    return F.struct(alpha.alias("alpha"), (1 - alpha).alias("beta"))


def fuse_scores(rows: DataFrame, coarse: str, key: str, weights: str) -> DataFrame:
    """Adds score = alpha * coarse + beta * key."""
    return rows.withColumn("score", F.col(f"{weights}.alpha") * F.col(coarse) + F.col(f"{weights}.beta") * F.col(key))


def hybrid_search(queries: DataFrame, vectors: DataFrame, on: str, hidden, out, threshold: float = 0.6, coarse_k: int = 10, k: int = 4) -> DataFrame:
    """Coarse top by the semantic vectors, fused with the similarity of the key vectors, final top k.

    queries(query_id, on, q, q_key), vectors(node_id, on, v, v_key), a node once for each value of ``on`` it belongs to.
    The limits come before anything is looked up for a result.
    """
    coarse = cosine_topk(queries.select("query_id", on, "q"), vectors.select("node_id", on, "v"), on, threshold, coarse_k).drop("rank")
    rows = coarse.join(queries.select("query_id", on, "q_key"), "query_id").join(vectors.select("node_id", on, "v_key"), ["node_id", on])
    rows = rows.withColumn("key_score", cosine(F.col("q_key"), F.col("v_key")))
    rows = fuse_scores(rows.withColumn("w", weight_gate(F.col("key_score"), F.col("similarity"), hidden, out)), "similarity", "key_score", "w")
    return top_k(rows.select("query_id", "node_id", "similarity", "key_score", "score"), "query_id", "score", k, "node_id")


def search(requests: DataFrame, nodes: DataFrame, vectors: DataFrame, edges: DataFrame, relation: str, lookups: Sequence[Association], positions: Sequence[Association], hidden, out, threshold: float = 0.6, coarse_k: int = 10, k: int = 4) -> DataFrame:
    """A table of questions answered end to end: sub-graph, coarse search, fused scores, final top k, associations.

    requests(query_id, category, iv, q, q_key) have the slots of a question and its two vectors; nodes(node_id,
    node_type, attributes, iv), vectors(node_id, v, v_key), edges.  A request is compared with the nodes of its category
    that have a vector, or all of them if the category is blank (``restrict_subgraph``).  Its row has ``results``, an array by
    rank of what was found with the rows of each of ``lookups``, and an array for each of ``positions`` about its iv.
    A node that many requests find is looked up once, and so is a position.  Requests that find nothing keep an empty array.
    """
    asked, members = restrict_subgraph(vectors.select("node_id"), edges, requests, relation)
    asked = asked.join(requests.select("query_id", "q", "q_key"), "query_id")
    found = hybrid_search(asked, members.join(vectors, "node_id"), "category", hidden, out, threshold, coarse_k, k).select("query_id", "node_id", "score", "rank")
    found = written(found, "found")
    about = associate_all(found.select(F.col("node_id").alias("request_id"), "node_id").distinct(), nodes, edges, list(lookups))
    rows = found.join(about.withColumnRenamed("request_id", "node_id"), "node_id")
    results = F.array_sort(F.collect_list(F.struct("rank", "node_id", "score", *[q.name for q in lookups]))).alias("results")
    answers = requests.select("query_id").join(rows.groupBy("query_id").agg(results), "query_id", "left")
    answers = answers.withColumn("results", F.coalesce("results", F.array()))
    if not positions:
        return answers
    return answers.join(associate_all(requests.select(F.col("query_id").alias("request_id"), "iv"), nodes, edges, list(positions)).withColumnRenamed("request_id", "query_id"), "query_id")


def lexicon_fallback(entities: Column, tagged: Column, text: Column) -> Column:
    """The text to embed for a question: its entities, else its lexicon terms, else itself."""
    return F.coalesce(F.nullif(entities, F.lit("")), F.nullif(tagged, F.lit("")), text)


def recommend(found: DataFrame, names: DataFrame) -> DataFrame:
    """found(query_id, node_id, score, rank), names(node_id, name): per query its results in order, with ranks from 1."""
    rows = found.join(names, "node_id", "left")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", "name"))).alias("results"))
