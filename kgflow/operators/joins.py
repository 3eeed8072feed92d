"""Joins of graph construction: intervals by bins, keys, ledgers, reference domains, aliases, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgflow.sources.scratch import written


#: Bins that an interval falls into at most on its level; a level's bins are as many times as wide as those of the one below.
_FAN = 64


def bin_width(*sides: DataFrame, iv: str = "iv") -> Column:
    """struct(width, top): twice the mean length of the intervals, 1 at least, so that an interval falls into 1.5 bins
    on average; and the level of the longest.  A subquery of the plan it is used in."""
    both = sides[0].select(iv)
    for s in sides[1:]:
        both = both.union(s.select(iv))
    length = F.col(f"{iv}.end") - F.col(f"{iv}.start")
    found = both.where(length >= 0).agg(F.avg(length).alias("mean"), F.max(length).alias("most"))
    width = F.greatest(F.lit(1.0), 2.0 * F.coalesce("mean", F.lit(0.0)))
    return found.select(F.struct(width.alias("width"), _level(F.coalesce("most", F.lit(0.0)) / width).alias("top"))).scalar()


def _level(span: Column) -> Column:
    """The level of an interval that is ``span`` bins long."""
    return F.when(span < _FAN, 0).otherwise(F.floor(F.log(F.greatest(span, F.lit(1.0))) / F.log(F.lit(float(_FAN))) + 1e-9)).cast("int")


def _bins(df: DataFrame, iv: str, bins: Column, up: str, met: str) -> DataFrame:
    """Rows by (__level, __role, __bin): an interval is in all bins of its own level, to meet others of that level
    (role 'own') and, above the lowest, shorter ones (``met``); and on all higher levels there are, to meet longer ones (``up``)."""
    start, end = F.col(f"{iv}.start"), F.col(f"{iv}.end")
    df, bins = df.withColumn("__bins", bins), F.col("__bins")
    role = lambda level, name: F.struct(level.cast("int").alias("level"), F.lit(name).alias("role"))
    own = F.least(_level((end - start) / bins["width"]), bins["top"])
    roles = F.concat(F.array(role(own, "own")), F.when(own > 0, F.array(role(own, met))).otherwise(F.array().cast("array<struct<level:int,role:string>>")), F.when(own < bins["top"], F.transform(F.sequence(own + 1, bins["top"]), lambda x: role(x, up))).otherwise(F.array().cast("array<struct<level:int,role:string>>")))
    rows = df.where(start <= end).select("*", F.inline(roles).alias("__l", "__r"))
    width = bins["width"] * F.pow(F.lit(float(_FAN)), F.col("__l"))
    return rows.withColumn("__bin", F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))).withColumn("__width", width)


def interval_overlap_join(left: DataFrame, right: DataFrame, width: float | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of rows, as structs ``a`` and ``b``, whose closed intervals ``iv`` share a prefix and a point.

    Both sides fall into bins; a pair is kept in the bin of the larger start only, so it comes
    once.  Equal work for equal bins: no row meets the rows of a whole prefix.  Intervals far
    longer than most lie on a level of wider bins, where shorter ones meet them, so none
    becomes many rows.  ``width`` fixes one width for all.  Reversed and NULL intervals meet nothing.
    """
    bins = F.struct(F.lit(float(width)).alias("width"), F.lit(0).alias("top")) if width else bin_width(left, right)
    key = [F.col("iv.prefix").alias("__p"), "__l", "__r", "__bin"]
    le = _bins(left, "iv", bins, "left", "right").select(F.struct(*left.columns).alias(a), *key, "__width")
    ri = _bins(right, "iv", bins, "right", "left").select(F.struct(*right.columns).alias(b), *key)
    start = F.greatest(F.col(f"{a}.iv.start"), F.col(f"{b}.iv.start"))
    met = le.join(ri, ["__p", "__l", "__r", "__bin"]).where((F.col(f"{a}.iv.start") <= F.col(f"{b}.iv.end")) & (F.col(f"{b}.iv.start") <= F.col(f"{a}.iv.end")))
    return met.where(F.floor(start / F.col("__width")) == F.col("__bin")).select(a, b)


def interval_contains_join(containers: DataFrame, contained: DataFrame, width: float | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs in which a's interval contains b's.  Only the containers fall into several bins, each on the level of its length."""
    bins = F.struct(F.lit(float(width)).alias("width"), F.lit(0).alias("top")) if width else bin_width(containers)
    key = [F.col("iv.prefix").alias("__p"), "__l", "__bin"]
    le = _bins(containers, "iv", bins, "none", "none").where("__r = 'own'").select(F.struct(*containers.columns).alias(a), *key)
    ri = contained.where("iv.start <= iv.end").withColumn("__bins", bins).withColumn("__l", F.explode(F.sequence(F.lit(0), F.col("__bins.top"))))
    at = F.floor(F.col("iv.start") / (F.col("__bins.width") * F.pow(F.lit(float(_FAN)), F.col("__l"))))
    ri = ri.select(F.struct(*contained.columns).alias(b), F.col("iv.prefix").alias("__p"), "__l", at.alias("__bin"))
    inside = (F.col(f"{a}.iv.start") <= F.col(f"{b}.iv.start")) & (F.col(f"{b}.iv.end") <= F.col(f"{a}.iv.end"))
    return le.join(ri, ["__p", "__l", "__bin"]).where(inside).select(a, b)


#: Left rows of one key that a block holds: each block meets the right rows of the key in a task of its own.
KEY_BLOCK = 4096
#: Left rows of one key that are numbered together.
KEY_PART = 65_536


def _in_rounds(le: DataFrame, ri: DataFrame, a: str, b: str, size: int, tasks: int) -> DataFrame:
    """le(a, __k), ri(b, __k): the pairs of equal keys, right row after right row with ``size`` left rows of the key each."""
    parts = le.groupBy("__k").agg(F.ceil(F.count("*") / KEY_PART).cast("int").alias("__n")).where("__n > 1")
    le = le.join(parts, "__k", "left").withColumn("__p", F.pmod(F.xxhash64(a), F.coalesce("__n", F.lit(1))).cast("int")).drop("__n")
    number = F.row_number().over(Window.partitionBy("__k", "__p").orderBy(F.xxhash64(a)))
    le = le.withColumn("__b", F.floor((number - 1) / size).cast("int"))
    blocks = le.groupBy("__k", "__p").agg(F.max("__b").alias("__most"))
    ri = ri.join(blocks, "__k").withColumn("__b", F.explode(F.sequence(F.lit(0), "__most"))).drop("__most")
    # of a sort-merge join the right side is held, a block at a time, while the rows of the left one pass by
    return ri.hint("merge").join(le.repartition(tasks, "__k", "__p", "__b"), ["__k", "__p", "__b"]).select(a, b)


def key_match_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, a: str = "a", b: str = "b", rounds: int = 0) -> DataFrame:
    """Pairs whose keys are equal as strings and not null.

    A key of many left rows is dealt into blocks, which its right rows go to as copies, so no task makes all pairs of a
    hot key; a key of ``KEY_BLOCK`` rows or fewer is one block.  There are as many pairs as the keys make: their number is the cost.
    Where keys have many rows on both sides, ``rounds`` left rows are a block, and each right row meets all of a block
    before the next one does: the pairs repeat few values at a time, which a written table holds in a fraction of the
    space.  Take a multiple of 8, the values that Parquet packs together.
    """
    le = left.select(F.struct(*left.columns).alias(a), F.col(left_key).cast("string").alias("__k")).where("__k IS NOT NULL")
    ri = right.select(F.struct(*right.columns).alias(b), F.col(right_key).cast("string").alias("__k"))
    tasks = 16 * left.sparkSession.sparkContext.defaultParallelism
    if rounds:
        return _in_rounds(le, ri, a, b, rounds, tasks)
    hot = le.groupBy("__k").agg(F.ceil(F.count("*") / KEY_BLOCK).cast("int").alias("__n")).where("__n > 1")
    blocks = F.coalesce("__n", F.lit(1))
    le = le.join(hot, "__k", "left").withColumn("__b", F.pmod(F.xxhash64(a), blocks).cast("int")).drop("__n")
    ri = ri.join(hot, "__k", "left").withColumn("__b", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("__n")
    return le.repartition(tasks, "__k", "__b").join(ri, ["__k", "__b"]).select(a, b)


def unprocessed(items: DataFrame, ledger: DataFrame, key: str, stage: str, force: bool = False) -> DataFrame:
    """Items that the ledger does not have as done in a stage; all of them under ``force``."""
    if force:
        return items
    done = ledger.where((F.col("stage") == stage) & (F.col("status") == "done")).select(key).distinct()
    return items.join(done, key, "left_anti")


def restrict_subgraph(nodes: DataFrame, edges: DataFrame, requests: DataFrame, relation: str) -> tuple[DataFrame, DataFrame]:
    """(requests as (query_id, category), members as (category, node_id)): the nodes that a request may find are the
    members of its category: those with an edge of the relation to it, or every node where it is blank, which is ''.

    nodes(node_id) are those that count, such as the ones that have a vector.  Requests share the members of a category,
    so nothing here grows with requests times nodes; '' has members only if some request is blank.
    """
    asked = requests.select("query_id", F.coalesce(F.trim("category"), F.lit("")).alias("category"))
    linked = edges.where((F.col("relation_type") == relation) & (F.trim("tail") != "")).select(F.col("head").alias("node_id"), F.col("tail").alias("category")).distinct()
    named = linked.join(nodes.select("node_id"), "node_id", "left_semi").select("category", "node_id")
    everything = nodes.select(F.lit("").alias("category"), "node_id")
    return asked, named.union(everything).join(asked.select("category").distinct(), "category", "left_semi")


def validate_domain(rows: DataFrame, allowed: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) against the reference table ``allowed`` with a column of the value's name."""
    ref = allowed.select(value).distinct()
    return rows.join(ref, value, "left_semi"), rows.join(ref, value, "left_anti")


def invalid_rate(valid: DataFrame, rejects: DataFrame, by: str) -> DataFrame:
    """Per group: numbers of valid and invalid rows, and the rate of invalid ones."""
    both = valid.select(by, F.lit(0).alias("bad")).union(rejects.select(by, F.lit(1)))
    return both.groupBy(by).agg(F.sum(1 - F.col("bad")).alias("n_valid"), F.sum("bad").alias("n_invalid"), F.avg("bad").alias("invalid_rate"))


def resolve_singletons(edges: DataFrame, nodes: DataFrame, reference: DataFrame, normalise) -> tuple[DataFrame, DataFrame]:
    """Re-points tails to the reference node of equal normalised value: (resolved edges, rejected edges).

    nodes(node_id, value), reference(ref_id, value).  Every rejected edge is told, none is lost silently.
    """
    named = edges.join(nodes.select(F.col("node_id").alias("tail"), normalise(F.col("value")).alias("__v")), "tail")
    ref = reference.select("ref_id", normalise(F.col("value")).alias("__v"))
    ok = named.join(ref, "__v").withColumn("tail", F.col("ref_id"))
    return ok.select(*edges.columns), named.join(ref, "__v", "left_anti").select(*edges.columns)


def relate_by_cardinality(heads: DataFrame, tails: DataFrame) -> DataFrame:
    """heads/tails(chunk_id, node_id, pos): 1:1, 1:n and n:1 pair all; n:m pairs by position up to the shorter."""

    def placed(df: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy("chunk_id")
        return df.select("chunk_id", F.col("node_id").alias(side), F.row_number().over(w.orderBy("pos", "node_id")).alias(f"{side}_rn"), F.count("*").over(w).alias(f"{side}_n"))

    h, t = placed(heads, "head"), placed(tails, "tail")
    # a side of one meets every row of the other; of two longer sides each row meets at most one
    ones = h.where("head_n = 1").join(t, "chunk_id").select("chunk_id", "head", "tail")
    ones = ones.union(h.where("head_n > 1").join(t.where("tail_n = 1"), "chunk_id").select("chunk_id", "head", "tail"))
    both = h.where("head_n > 1").withColumnRenamed("head_rn", "rn").join(t.where("tail_n > 1").withColumnRenamed("tail_rn", "rn"), ["chunk_id", "rn"])
    return ones.union(both.select("chunk_id", "head", "tail"))


def relate_array_groups(heads: DataFrame, tails: DataFrame) -> DataFrame:
    """heads/tails(chunk_id, node_id, element): nodes made from the same array element are linked."""
    return heads.select("chunk_id", "element", F.col("node_id").alias("head")).join(tails.select("chunk_id", "element", F.col("node_id").alias("tail")), ["chunk_id", "element"])


def resolve_aliases(aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """aliases(node_id, kept_id), of which a node's smallest kept_id counts: (node_id, the node that its chain of aliases ends at; rows of cycles).

    Pointer jumping: each round halves the chains, over a table written in shared scratch space.  A node that is kept
    itself, or is its own alias, ends a chain.  Aliases that end nowhere go round a cycle or lead into one.
    """
    at = written(aliases.where("node_id <> kept_id").groupBy("node_id").agg(F.min("kept_id").alias("kept_id")), "aliases")
    rounds = max(1, at.count()).bit_length() + 1  # a longer chain has come back to where it was
    for _ in range(rounds):
        up = at.select(F.col("node_id").alias("kept_id"), F.col("kept_id").alias("above"))
        at = written(at.drop("moved").join(up, "kept_id", "left").select("node_id", F.coalesce("above", "kept_id").alias("kept_id"), F.col("above").isNotNull().alias("moved")), "aliases")
        if at.where("moved").isEmpty():
            break
    return at.where("NOT moved").drop("moved"), at.where("moved").select("node_id").join(aliases, "node_id").select("node_id", "kept_id")


def remap_edges(edges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """aliases(node_id, kept_id): (edges between the nodes that are kept in the end, each (head, relation_type, tail)
    once; the aliases that go round a cycle).  Edges of nodes in a cycle stay where they are."""
    ends, cycles = resolve_aliases(aliases)
    for side in ("head", "tail"):
        alias = ends.select(F.col("node_id").alias(side), F.col("kept_id").alias("__kept"))
        edges = edges.join(alias, side, "left").withColumn(side, F.coalesce("__kept", side)).drop("__kept")
    return edges.select("head", "relation_type", "tail").distinct(), cycles


def rebuild_relations(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """nodes(source_file, node_type, node_id), relations(relation_type, head_type, tail_type): all pairs within a file."""
    h = nodes.select("source_file", F.col("node_type").alias("head_type"), F.col("node_id").alias("head"))
    t = nodes.select("source_file", F.col("node_type").alias("tail_type"), F.col("node_id").alias("tail"))
    return h.join(relations, "head_type").join(t, ["source_file", "tail_type"]).select("source_file", "relation_type", "head", "tail")


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by an order: upserts."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("__rn = 1").drop("__rn")
