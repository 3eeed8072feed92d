"""Inference rules compiled to joins: single hops by key, attribute or interval, and multi-hop paths."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgflow.operators.joins import interval_contains_join, interval_overlap_join, key_match_join
from kgflow.sources.scratch import written


@dataclass(frozen=True)
class SingleHop:
    """kind: id_match, attribute_match, overlap, contains, contained_by, or explicit_relation, which takes stored edges of
    ``relation`` as they are."""

    relation_type: str
    head_type: str
    tail_type: str
    kind: str
    head_key: str = "node_id"
    tail_key: str = "node_id"
    confidence: float = 0.9
    relation: str = ""


@dataclass(frozen=True)
class Step:
    """One step of a chain between nodes of two types.

    kind 'edge' follows stored edges of ``relation``, from head to tail (direction OUT) or back (IN), with their
    confidence; the other kinds are those of ``SingleHop``, with the step's own.
    """

    kind: str
    from_type: str
    to_type: str
    relation: str = ""
    direction: str = "OUT"
    from_key: str = "node_id"
    to_key: str = "node_id"
    confidence: float = 0.9


@dataclass(frozen=True)
class MultiHop:
    """A chain of steps, each from the type that the one before it leads to; kinds may be mixed."""

    relation_type: str
    steps: tuple[Step, ...]
    confidence: str = "last"
    max_paths: int = 3

    def __post_init__(self):
        if not self.steps or any(x.to_type != y.from_type for x, y in pairwise(self.steps)):
            raise ValueError(f"the steps of {self.relation_type} make no chain")

    @property
    def types(self) -> list[str]:
        """The node type of each place on a path."""
        return [self.steps[0].from_type, *(s.to_type for s in self.steps)]


def match_step(heads: DataFrame, tails: DataFrame, rule: SingleHop, edges: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of the rule's kind of step; explicit relations are looked up in ``edges``, parallel ones once."""
    if rule.kind == "explicit_relation":
        stored = edges.where(F.col("relation_type") == rule.relation).select("head", "tail").distinct()
        a, b = heads.select(F.struct(*heads.columns).alias("a")), tails.select(F.struct(*tails.columns).alias("b"))
        return stored.join(a, F.col("head") == F.col("a.node_id")).join(b, F.col("tail") == F.col("b.node_id")).select("a", "b")
    if rule.kind in ("id_match", "attribute_match"):
        return key_match_join(heads, tails, rule.head_key, rule.tail_key)
    if rule.kind == "overlap":
        return interval_overlap_join(heads, tails)
    if rule.kind == "contains":
        return interval_contains_join(heads, tails)
    if rule.kind == "contained_by":
        return interval_contains_join(tails, heads, a="b", b="a").select("a", "b")
    raise ValueError(f"unknown step kind: {rule.kind}")


def infer_single_hop(nodes: DataFrame, rule: SingleHop, edges: DataFrame | None = None) -> DataFrame:
    """Edges (relation_type, head, tail, confidence, method, evidence) between the rule's two node types."""
    met = match_step(nodes.where(F.col("node_type") == rule.head_type), nodes.where(F.col("node_type") == rule.tail_type), rule, edges)
    evidence = F.concat(F.lit(f"{rule.kind}: "), F.col("a.node_id"), F.lit(" ~ "), F.col("b.node_id"))
    return met.where("a.node_id <> b.node_id").select(
        F.lit(rule.relation_type).alias("relation_type"), F.col("a.node_id").alias("head"), F.col("b.node_id").alias("tail"),
        F.lit(rule.confidence).alias("confidence"), F.lit(rule.kind).alias("method"), evidence.alias("evidence"),
    )


#: Nodes for each task of a chain: the tasks grow with the graph, their rows do not.
NODE_BLOCK = 50_000
#: A step of more pairs than this is met by paths that are dealt for it, more ends by pairs that are; fewer move none.
SMALL_STEP = 100_000


def step_pairs(nodes: DataFrame, edges: DataFrame, step: Step, ends: DataFrame, tasks: int) -> DataFrame:
    """(at, to, c): where one step leads, from nodes of its first type to those of its second that ``ends`` (to) has, dealt
    by ``at`` into ``tasks``."""
    first, second = (nodes.where(F.col("node_type") == t) for t in (step.from_type, step.to_type))
    if step.kind == "edge":
        at, to = ("head", "tail") if step.direction == "OUT" else ("tail", "head")
        led = edges.where(F.col("relation_type") == step.relation).select(F.col(at).alias("at"), F.col(to).alias("to"), F.col("confidence").alias("c"))
        few = ends.count() <= SMALL_STEP
        led = led.join(F.broadcast(ends.distinct()), "to") if few else led.repartition(tasks, "to").join(ends.repartition(tasks, "to").distinct(), "to")
        # no semi-joins, which Spark moves below the dealing
        return led.repartition(tasks, "at").join(first.select(F.col("node_id").alias("at")).repartition(tasks, "at").distinct(), "at").select("at", "to", "c")
    by_key = step.kind in ("id_match", "attribute_match")
    a, b = (dict.fromkeys(["node_id", key if by_key else "iv"]) for key in (step.from_key, step.to_key))
    wanted = second.select(*b).join(ends.select(F.col("to").alias("node_id")), "node_id", "left_semi")
    rule = SingleHop("", step.from_type, step.to_type, step.kind, step.from_key, step.to_key)
    met = match_step(first.select(*a), wanted, rule).select(F.col("a.node_id").alias("at"), F.col("b.node_id").alias("to"))
    return met.where("at <> to").repartition(tasks, "at").withColumn("c", F.lit(step.confidence))


def infer_multi_hop(nodes: DataFrame, edges: DataFrame, rule: MultiHop) -> DataFrame:
    """Edges (relation_type, head, tail, confidence, method, evidence) from a path's first node to its last.

    No node occurs twice on a path; at most ``max_paths`` paths of a source count, the first in the order of their
    nodes.  confidence 'last' is the last step's, 'product' that of all steps to 4 places; of parallel edges the highest.

    From the last step backwards, each step keeps only what leads to a node from which the rest of the chain can be
    walked, so no path is begun that cannot end.  Going forward, paths are cut as soon as none of the places to come has
    the type of an earlier one: then every path ends, a source needs no more than its first ``max_paths``, and a node no
    more than that many next ones and one for each node it may not visit again.  So a rule through a hub costs its
    edges and its result, not the square of the hub; a type that comes back later is followed in full until it has come.
    Steps after the first are written in shared scratch space, cut like that.  Pairs are dealt by where they start, paths
    by the node they have come to, into tasks that grow with the number of nodes; a small step moves no path.
    """
    types, k = rule.types, rule.max_paths
    certain = [all(types[j] not in types[:j] for j in range(place + 1, len(types))) for place in range(len(types))]
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // NODE_BLOCK))
    pairs: list[DataFrame] = []
    ends = nodes.where(F.col("node_type") == types[-1]).select(F.col("node_id").alias("to"))
    for place in range(len(rule.steps), 0, -1):
        led = step_pairs(nodes, edges, rule.steps[place - 1], ends, tasks)
        if certain[place] and place > 1:  # those of the first step are paths, which are cut below
            nth = F.dense_rank().over(Window.partitionBy("at").orderBy("to"))
            led = led.withColumn("nth", nth).where(F.col("nth") <= k + types[:place].count(types[place]))
        led = led.groupBy("at", "to").agg(F.max("c").alias("c"))
        if place > 1:  # the step before it and the paths read it
            led = written(led, "step")
            ends = led.select(F.col("at").alias("to")).distinct()
        pairs.insert(0, led)
    paths = None  # path: the nodes before ``at``
    for place, led in enumerate(pairs, 1):
        if paths is None:
            paths = led.where("at <> to").select(F.col("at").alias("head"), F.array("at").alias("path"), F.col("to").alias("at"), "c")
        else:
            if led.count() > SMALL_STEP:
                paths = paths.drop("head").repartition(tasks, "at").withColumn("head", F.element_at("path", 1))
            c = F.col("c") if rule.confidence == "last" else F.col("before") * F.col("c")
            met = paths.withColumnRenamed("c", "before").join(led, "at").where((F.col("to") != F.col("at")) & ~F.array_contains("path", F.col("to")))
            paths = met.select("head", F.array_append("path", F.col("at")).alias("path"), F.col("to").alias("at"), c.alias("c"))
        if certain[place]:
            order = Window.partitionBy("head").orderBy("path", "at")
            paths = paths.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")
    return paths.select(
        F.lit(rule.relation_type).alias("relation_type"), "head", F.col("at").alias("tail"), F.round("c", 4).alias("confidence"),
        F.lit("multi_hop").alias("method"), F.array_join(F.array_append("path", F.col("at")), " > ").alias("evidence"),
    )


def rule_statistics(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count_distinct("head").alias("n_sources"), F.count_distinct("tail").alias("n_targets"), F.count("*").alias("n_edges"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n): nodes by type and edges by relation."""
    n = nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("type")).agg(F.count("*").alias("n"))
    return n.union(edges.groupBy(F.lit("edge").alias("kind"), F.col("relation_type").alias("type")).agg(F.count("*").alias("n")))
