"""Declarative association look-ups, run for a whole table of requests at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgflow.operators.joins import interval_overlap_join
from kgflow.sources.scratch import written


@dataclass(frozen=True)
class Step:
    """From a node along edges of a relation (direction OUT, IN or BOTH) to nodes of a type, or of any."""

    relation_type: str
    direction: str = "OUT"
    optional: bool = False
    node_type: str | None = None


@dataclass(frozen=True)
class Field:
    """An attribute of the node of a step (0: the anchor; -1: the last step), its name, and what stands for a missing one."""

    attribute: str
    alias: str
    fallback: str | None = None
    step: int = -1


@dataclass(frozen=True)
class Association:
    """kind 'direct', 'path' or 'interval'; steps follow the anchor or, for intervals, each overlapping node."""

    name: str
    fields: tuple[Field, ...]
    steps: tuple[Step, ...] = ()
    kind: str = "path"
    node_type: str | None = None


    def step_of(self, field: Field) -> int:
        return field.step if field.step >= 0 else len(self.steps)

    @property
    def row(self) -> Column:
        """The struct of the query's fields."""
        return F.struct(*[F.coalesce(F.col(f"__a{self.step_of(f)}")[f.attribute], F.lit(f.fallback)).alias(f.alias) for f in self.fields])


def _named(nodes: DataFrame, queries: list[Association], k: int, node_type: str | None) -> DataFrame:
    """(__n<k>, __a<k>): nodes of a type with those attributes that some query asks of its k-th step."""
    wanted = sorted({f.attribute for q in queries for f in q.fields if q.step_of(f) == k})
    typed = nodes.where(F.col("node_type") == node_type) if node_type else nodes
    attributes = F.struct(*[F.col("attributes")[a].alias(a) for a in wanted] or [F.lit(True).alias("known")])
    return typed.select(F.col("node_id").alias(f"__n{k}"), attributes.alias(f"__a{k}"))


def _grow(rows: DataFrame, nodes: DataFrame, edges: DataFrame, step: Step, k: int, queries: list[Association]) -> DataFrame:
    """rows that are at their k-th node, moved along a step."""
    e = edges.where(F.col("relation_type") == step.relation_type)
    out, into = (e.select(F.col(a).alias(f"__n{k}"), F.col(b).alias(f"__n{k + 1}")) for a, b in (("head", "tail"), ("tail", "head")))
    hop = {"OUT": out, "IN": into}.get(step.direction, out.union(into))
    return rows.join(hop.join(_named(nodes, queries, k + 1, step.node_type), f"__n{k + 1}"), f"__n{k}", "left" if step.optional else "inner")


def _roots(anchors: DataFrame, nodes: DataFrame, query: Association, queries: list[Association]) -> DataFrame:
    """(__anchor, __n0, __a0): where the paths of queries of one kind begin."""
    known = _named(nodes, queries, 0, query.node_type if query.kind == "interval" else None)
    if query.kind == "interval":
        typed = nodes.where(F.col("node_type") == query.node_type) if query.node_type else nodes
        met = interval_overlap_join(anchors.withColumnRenamed("__anchor", "iv"), typed.select("node_id", "iv"))
        return met.select(F.col("a.iv").alias("__anchor"), F.col("b.node_id").alias("__n0")).join(known, "__n0")
    return anchors.withColumn("__n0", F.col("__anchor")).join(known, "__n0", "left" if query.kind == "direct" else "inner")


def _found(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, queries: list[Association]) -> list[DataFrame]:
    """The rows of each query, by the tree that their steps make: a place that several ways lead on from is written once."""
    out: dict[int, DataFrame] = {}

    def walk(rows: DataFrame, at: tuple[Step, ...], through: list[Association]) -> None:
        ending = [q for q in through if q.steps == at]
        on = dict.fromkeys(q.steps[: len(at) + 1] for q in through if q.steps != at)
        if len(ending) + len(on) > 1:
            rows = written(rows, "association")
        for q in ending:
            out[queries.index(q)] = rows
        for steps in on:
            further = [q for q in through if q.steps[: len(steps)] == steps]
            walk(_grow(rows, nodes, edges, steps[-1], len(at), further), steps, further)

    for root in dict.fromkeys((q.kind, q.node_type if q.kind == "interval" else None) for q in queries):
        own = [q for q in queries if (q.kind, q.node_type if q.kind == "interval" else None) == root]
        walk(_roots(anchors, nodes, own[0], own), (), own)
    return [out[i] for i in range(len(queries))]


def _anchor(queries: list[Association]) -> str:
    """The column of requests that the queries start from; all are about nodes or all about positions."""
    by = {q.kind == "interval" for q in queries}
    if len(by) > 1:
        raise ValueError("look-ups of nodes and of positions cannot share requests")
    return "iv" if by == {True} else "node_id"


def associate(requests: DataFrame, nodes: DataFrame, edges: DataFrame, query: Association) -> DataFrame:
    """requests(request_id, node_id) or, for intervals, (request_id, iv): rows of request_id and the query's fields.

    The anchor is found first, then the required steps, then optional ones as outer joins,
    so a filter on the anchor never depends on an optional match.  A direct look-up gives a
    row for every request, of fallbacks if its node is unknown.
    """
    by = F.col(_anchor([query])).alias("__anchor")
    rows = _found(requests.select(by).distinct(), nodes, edges, [query])[0].select("__anchor", query.row.alias("__row"))
    return requests.select("request_id", by).join(rows, "__anchor").select("request_id", "__row.*")


def associate_all(requests: DataFrame, nodes: DataFrame, edges: DataFrame, queries: list[Association]) -> DataFrame:
    """One row per request and anchor: for each query an array of its rows, sorted, empty where it found none.

    Equal anchors are looked up once, and so is every step that queries have in common from the start: the edges of a
    relation are joined once for each place in the tree of steps.  All rows are gathered by anchor in one shuffle.
    """
    by = F.col(_anchor(queries)).alias("__anchor")
    asked = requests.select("request_id", by).distinct()
    found = None
    for q, rows in zip(queries, _found(asked.select("__anchor").distinct(), nodes, edges, queries), strict=True):
        own = rows.select("__anchor", q.row.alias(q.name))
        found = own if found is None else found.unionByName(own, allowMissingColumns=True)
    lists = found.groupBy("__anchor").agg(*[F.sort_array(F.collect_list(q.name)).alias(q.name) for q in queries])
    return asked.join(lists, "__anchor", "left").select("request_id", *[F.coalesce(q.name, F.array()).alias(q.name) for q in queries])


def _own(query: Association, k: int, ahead: Column | None) -> Column:
    """The struct of those fields that a query asks of its k-th step, in ``__a<k>``, and of later ones: from ``ahead``, or all missing."""
    later = lambda f: F.lit(f.fallback) if ahead is None else ahead[f.alias]
    at = [(f, query.step_of(f)) for f in query.fields]
    fields = [(F.coalesce(F.col(f"__a{k}")[f.attribute], F.lit(f.fallback)) if j == k else later(f)).alias(f.alias) for f, j in at if j >= k]
    return F.struct(*fields or [F.lit(True).alias("known")])


def _ends(n: Column, first: Column, last: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), first.alias("first"), last.alias("last"))


def _met(rows: DataFrame, by: str, queries: list[Association]) -> DataFrame:
    """The ends of all rows of each ``by``, per query; NULL where a query has no row."""
    sums = [_ends(F.sum(f"{q.name}.n"), F.min(f"{q.name}.first"), F.max(f"{q.name}.last")).alias(q.name) for q in queries]
    found = rows.groupBy(by).agg(*sums, F.lit(True).alias("__met"))
    return found.withColumns({q.name: F.when(F.col(f"{q.name}.n").isNotNull(), F.col(q.name)) for q in queries})


def _summed(nodes: DataFrame, edges: DataFrame, at: tuple[Step, ...], through: list[Association], node_type: str | None) -> DataFrame:
    """(__n<k>, per query its ends): what each node at a place of the tree leads to, by what the places after it lead to."""
    k = len(at)
    rows, ends = _named(nodes, through, k, node_type), {}
    for q in through:
        if q.steps == at:
            ends[q.name] = _ends(F.lit(1), _own(q, k, None), _own(q, k, None))
    for step in dict.fromkeys(q.steps[k] for q in through if q.steps != at):
        further = [q for q in through if q.steps[: k + 1] == (*at, step)]
        e = edges.where(F.col("relation_type") == step.relation_type)
        out, into = (e.select(F.col(a).alias(f"__n{k}"), F.col(b).alias(f"__n{k + 1}")) for a, b in (("head", "tail"), ("tail", "head")))
        hop = {"OUT": out, "IN": into}.get(step.direction, out.union(into))
        ahead = _met(hop.join(_summed(nodes, edges, (*at, step), further, step.node_type), f"__n{k + 1}"), f"__n{k}", further)
        rows = rows.join(ahead.withColumnRenamed("__met", f"__met{len(ends)}"), f"__n{k}", "left")
        met = F.col(f"__met{len(ends)}").isNotNull()
        for q in further:
            x = F.col(q.name)
            led = F.when(x.isNotNull(), _ends(x["n"], _own(q, k, x["first"]), _own(q, k, x["last"])))
            none = _ends(F.lit(1), _own(q, k, None), _own(q, k, None)) if all(s.optional for s in q.steps[k:]) else F.lit(None)
            ends[q.name] = F.when(met, led).otherwise(none)
    return rows.select(f"__n{k}", *[ends[q.name].alias(q.name) for q in through])


def associate_ends(requests: DataFrame, nodes: DataFrame, edges: DataFrame, queries: list[Association]) -> DataFrame:
    """One row per request and anchor: for each query struct(n, first, last), the number of its rows and the ends of their order.

    What ``associate_all`` lists, told without listing it.  From the last steps of the tree backwards each node sums up
    what it leads to, so a node that many paths share is told once: the cost is that of the edges, not of the paths,
    and a hub that all requests pass is no more than its edges.
    """
    by = F.col(_anchor(queries)).alias("__anchor")
    asked = requests.select("request_id", by).distinct()
    anchors, out = asked.select("__anchor").distinct(), asked
    for root in dict.fromkeys((q.kind, q.node_type if q.kind == "interval" else None) for q in queries):
        own = [q for q in queries if (q.kind, q.node_type if q.kind == "interval" else None) == root]
        told = _summed(nodes, edges, (), own, root[1])
        if root[0] == "interval":
            typed = nodes.where(F.col("node_type") == root[1]) if root[1] else nodes
            met = interval_overlap_join(anchors.withColumnRenamed("__anchor", "iv"), typed.select("node_id", "iv"))
            told = met.select(F.col("a.iv").alias("__anchor"), F.col("b.node_id").alias("__n0")).join(told, "__n0").drop("__n0")
        else:
            told = told.withColumnRenamed("__n0", "__anchor")
        out = out.join(_met(told, "__anchor", own).withColumnRenamed("__met", f"__met_{root[0]}_{root[1]}"), "__anchor", "left")
        if root[0] == "direct":
            known = F.col("__anchor").isNull() | F.col(f"__met_{root[0]}_{root[1]}").isNotNull()
            missing = lambda q: F.struct(*[F.lit(f.fallback).alias(f.alias) for f in q.fields])
            out = out.withColumns({q.name: F.when(known, F.col(q.name)).otherwise(_ends(F.lit(1), missing(q), missing(q))) for q in own if all(s.optional for s in q.steps)})
    none = lambda q: F.coalesce(q.name, _ends(F.lit(0), F.lit(None), F.lit(None)))
    return out.select("request_id", *[none(q).alias(q.name) for q in queries])
