"""Merge keys, dedup and merge policies over node tables.

Nodes are rows of (source_file, chunk_id, node_id, node_type, attributes map, confidence, ord);
``ord`` orders the nodes of a document, so that every "first" has one meaning.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOC = ("source_file", "node_type")


def merge_key(label: Column, attributes: Column) -> Column:
    """``label|k:v|...`` over the attributes that are not null or empty, by name."""
    full = F.filter(F.array_sort(F.map_entries(attributes)), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.concat(F.array(label), F.transform(full, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "|")


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), F.col("ord"))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """The node of the highest confidence for each merge_key of a chunk, the first of equals."""
    return _best(nodes, ["chunk_id", "merge_key"])


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The edge of the highest confidence for each head, relation and tail of a chunk."""
    return _best(edges, ["chunk_id", "head", "relation_type", "tail"])


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Per group an array of its distinct values in the order of their first ``ord``; copies go before the shuffle."""
    first = rows.groupBy(*keys, value).agg(F.min("ord").alias("o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def merge_global(nodes: DataFrame) -> DataFrame:
    """One node per merge_key: first attributes and id, highest confidence, ordered distinct chunks and node ids.

    The rows of a key and chunk become one before those of a key meet, so a key of many nodes gathers chunks, each with
    the sorted list of its own.
    """
    entry = F.struct("ord", F.col("node_id").alias("v"))
    chunks = nodes.groupBy("merge_key", "chunk_id").agg(
        F.min("ord").alias("o"), F.min_by("attributes", "ord").alias("attributes"), F.min_by("node_id", "ord").alias("node_id"),
        F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(entry)).alias("ids"),
    )
    held = F.array_sort(F.collect_list(F.struct("o", "chunk_id", "ids")))
    merged = chunks.groupBy("merge_key").agg(F.min_by("node_id", "o").alias("node_id"), F.min_by("attributes", "o").alias("attributes"), F.max("confidence").alias("confidence"), held.alias("held"))
    ids = F.array_distinct(F.transform(F.array_sort(F.flatten(F.transform("held", lambda x: x["ids"]))), lambda x: x["v"]))
    return merged.select("merge_key", "node_id", "attributes", "confidence", F.transform("held", lambda x: x["chunk_id"]).alias("source_chunks"), ids.alias("all_node_ids"))


def dedup_by_property(nodes: DataFrame, key: str) -> DataFrame:
    """(node_type, key, kept_id, n, node_ids) of the groups that have several nodes; the lowest id is kept."""
    g = nodes.groupBy("node_type", key).agg(F.min("node_id").alias("kept_id"), F.count("*").alias("n"), F.sort_array(F.collect_set("node_id")).alias("node_ids"))
    return g.where("n > 1")


def _values(nodes: DataFrame) -> DataFrame:
    return nodes.select(*DOC, "ord", F.explode("attributes").alias("attr", "value"))


def _as_map(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.groupBy(*DOC).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", value)))).alias("attributes"))


def agg_merge_descriptions(nodes: DataFrame) -> DataFrame:
    """Distinct values that are not empty, sorted and joined by a full-width semicolon; attributes of the first node only.

    Each node adds a row without attribute: the first of those is the first node, which has the attributes that begin there.
    """
    own = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    entries = F.concat(F.coalesce(F.map_entries("attributes"), own), own)
    rows = nodes.select(*DOC, "ord", F.explode(entries).alias("e")).select(*DOC, "ord", F.col("e.key").alias("attr"), "e.value")
    found = rows.groupBy(*DOC, "attr").agg(F.array_join(F.array_sort(F.collect_set(F.nullif("value", F.lit("")))), "；").alias("value"), F.min("ord").alias("first"))
    listed = found.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("attr", "value", "first"))).alias("held"), F.min("first").alias("first"))
    kept = F.filter("held", lambda e: e["attr"].isNotNull() & (e["value"] != "") & (e["first"] == F.col("first")))
    return listed.select(*DOC, F.map_from_entries(F.transform(kept, lambda e: F.struct(e["attr"], e["value"]))).alias("attributes")).where(F.size("attributes") > 0)


def agg_merge_attributes(nodes: DataFrame) -> DataFrame:
    """The first value of every attribute that a node of the group has."""
    return _as_map(_values(nodes).where("value IS NOT NULL").groupBy(*DOC, "attr").agg(F.min_by("value", "ord").alias("value")))


def parse_date(text: Column) -> Column:
    """The first ``YYYY年M月D日`` or ``YYYY-M-D`` in a text as a date; NULL if there is none or it is no date."""
    pattern = r"(\d{4})[年-](\d{1,2})[月-](\d{1,2})"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.try_to_date(F.concat(part(1), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")


def agg_select_earliest(nodes: DataFrame, attr: str) -> DataFrame:
    """The node of the earliest date, else the first."""
    date = F.coalesce(parse_date(F.col("attributes")[attr]), F.lit("9999-12-31").cast("date"))
    return nodes.groupBy(*DOC).agg(F.min_by(F.struct("node_id", "attributes"), F.struct(date, "ord")).alias("n")).select(*DOC, "n.node_id", "n.attributes")


def agg_select_most_common(nodes: DataFrame) -> DataFrame:
    """The most frequent value of each attribute, the first seen of equals; confidence 0.9, or a single node's own.

    Each node adds a row without attribute, which counts it and carries its confidence.
    """
    own = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    entries = F.concat(F.filter(F.map_entries("attributes"), lambda e: e["value"].isNotNull()), own)
    rows = nodes.select(*DOC, "ord", "confidence", F.explode(entries).alias("e")).select(*DOC, "ord", "confidence", F.col("e.key").alias("attr"), "e.value")
    counts = rows.groupBy(*DOC, "attr", "value").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("confidence").alias("confidence"))
    best = counts.groupBy(*DOC, "attr").agg(F.min_by("value", F.struct(-F.col("n"), "first")).alias("value"), F.max("n").alias("n"), F.max("confidence").alias("confidence"))
    node = F.col("attr").isNull()
    listed = F.filter(F.array_sort(F.collect_list(F.struct("attr", "value"))), lambda e: e["attr"].isNotNull())
    confidence = F.when(F.max(F.when(node, F.col("n"))) == 1, F.max(F.when(node, F.col("confidence")))).otherwise(0.9)
    return best.groupBy(*DOC).agg(F.map_from_entries(listed).alias("attributes"), confidence.alias("confidence")).where(F.size("attributes") > 0)


def agg_create_single(nodes: DataFrame) -> DataFrame:
    """The first value that is not empty of each attribute; confidence 0.85."""
    rows = _values(nodes).where("value <> ''").groupBy(*DOC, "attr").agg(F.min_by("value", "ord").alias("value"))
    return _as_map(rows).withColumn("confidence", F.lit(0.85))


def agg_merge_unique(nodes: DataFrame) -> DataFrame:
    """One node per distinct set of attributes, with the ordered distinct chunks it came from."""
    keyed = nodes.withColumn("entries", F.array_sort(F.map_entries("attributes")))
    return ordered_distinct(keyed, [*DOC, "entries"], "chunk_id", "source_chunks").select(*DOC, F.map_from_entries("entries").alias("attributes"), "source_chunks")


def agg_merge_all(nodes: DataFrame) -> DataFrame:
    """Every node, under a new merge key."""
    return nodes.withColumn("merge_key", merge_key(F.col("node_type"), F.col("attributes")))


def aggregate_documents(nodes: DataFrame, strategies: Mapping[str, str], date_attr: str) -> DataFrame:
    """(source_file, node_type, attributes) by the strategy of each node type; other types stay as they are."""
    policies = {
        "merge_descriptions": agg_merge_descriptions, "merge_attributes": agg_merge_attributes, "select_most_common": agg_select_most_common,
        "create_single": agg_create_single, "merge_unique": agg_merge_unique, "select_earliest": lambda n: agg_select_earliest(n, date_attr),
    }
    out = nodes.where(~F.coalesce(F.col("node_type").isin(*strategies), F.lit(False))).select(*DOC, "attributes")
    for name in sorted(set(strategies.values())):
        types = [t for t, s in strategies.items() if s == name]
        out = out.union(policies[name](nodes.where(F.col("node_type").isin(*types))).select(*DOC, "attributes"))
    return out


def merge_change_nodes(nodes: DataFrame) -> DataFrame:
    """First value per attribute, under the id of the most confident node."""
    ids = nodes.groupBy(*DOC).agg(F.min_by("node_id", F.struct(-F.col("confidence"), "ord")).alias("node_id"))
    return agg_merge_attributes(nodes).join(ids, list(DOC))


def merge_response_nodes(nodes: DataFrame) -> DataFrame:
    """nodes(source_file, node_type, text, keywords array): distinct texts joined, keywords flattened and distinct; groups of one stay."""
    text = F.array_join(F.array_sort(F.collect_set("text")), "；")
    return nodes.groupBy(*DOC).agg(text.alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("keywords"))


def keep_last_section(nodes: DataFrame) -> DataFrame:
    """The node of the highest section, the first of equals; without any section the first node."""
    order = F.struct(F.coalesce(-F.col("section"), F.lit(2**31)), "ord")
    return nodes.groupBy(*DOC).agg(F.min_by("node_id", order).alias("node_id"), F.min_by("section", order).alias("section"))
