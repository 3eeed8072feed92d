"""Records and model responses to nodes and edges, by configuration."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgflow.functions.text import composite_field, extract_json, json_collect_remaining, json_path_get, map_synonyms
from kgflow.operators.extractors import Find, extract_nodes


@dataclass(frozen=True)
class NodeMapping:
    """How a node type comes from a JSON record: attribute to path, to metadata column, to (paths, separator);
    ``remaining`` names the attribute for all other fields; ``array`` the field whose elements each make a node."""

    node_type: str
    fields: Mapping[str, str] = field(default_factory=dict)
    metadata: Mapping[str, str] = field(default_factory=dict)
    composite: Mapping[str, tuple[Sequence[str], str]] = field(default_factory=dict)
    remaining: str | None = None
    array: str | None = None


def _attributes(doc: Column, metadata: Column, m: NodeMapping) -> Column:
    """The attributes that a mapping finds in a JSON text; each value is read once."""
    entries = []
    for a in dict.fromkeys([*m.fields, *m.metadata, *m.composite]):
        found = []
        if a in m.metadata:
            found.append(metadata[m.metadata[a]])
        if a in m.composite:
            paths, sep = m.composite[a]
            found.append(composite_field([json_path_get(doc, p) for p in paths], sep))
        if a in m.fields:
            found.append(json_path_get(doc, m.fields[a]))
        entries.append(F.struct(F.lit(a).alias("k"), F.coalesce(*found).alias("v")))
    keep = lambda e: e["v"].isNotNull()
    if m.remaining:
        used = [*m.fields.values(), *[p for ps, _ in m.composite.values() for p in ps]]
        entries.append(F.struct(F.lit(m.remaining).alias("k"), json_collect_remaining(doc, used).alias("v")))
        keep = lambda e: e["v"].isNotNull() & ((e["k"] != m.remaining) | (e["v"] != ""))
    return F.map_from_entries(F.filter(F.array(*entries), keep))


def map_json_nodes(records: DataFrame, mappings: Sequence[NodeMapping]) -> DataFrame:
    """records(chunk_id, json, metadata map): (chunk_id, element, node_type, attributes); no node without an attribute.

    The records are read once: each makes the nodes of all its mappings before they become rows.
    """

    def node(m: NodeMapping, doc: Column, element: Column) -> Column:
        return F.struct(element.alias("element"), F.lit(m.node_type).alias("node_type"), _attributes(doc, F.col("metadata"), m).alias("attributes"))

    def nodes(m: NodeMapping) -> Column:
        if not m.array:
            return F.array(node(m, F.col("json"), F.lit(0)))
        elements = F.from_json(F.get_json_object("json", f"$.{m.array}"), "array<string>")
        return F.transform(F.coalesce(elements, F.array().cast("array<string>")), lambda e, i: node(m, e, i))

    rows = records.select("chunk_id", F.explode(F.concat(*[nodes(m) for m in mappings])).alias("n"))
    return rows.select("chunk_id", "n.*").where(F.size("attributes") > 0)


def scan_json_records(files: DataFrame) -> DataFrame:
    """files(source_file, text) of an array of records or one record: (source_file, pos, json)."""
    array = F.from_json("text", "array<string>")
    one = F.trim("text").startswith("{")
    return files.select("source_file", F.posexplode(F.when(one, F.array("text")).otherwise(array)).alias("pos", "json"))


_RESPONSE = "struct<nodes:array<struct<node_type:string,attributes:map<string,string>>>,relations:array<struct<head_type:string,tail_type:string,relation_type:string>>,attributes:map<string,string>>"


def nodes_from_response(responses: DataFrame, node_types: Sequence[str]) -> DataFrame:
    """responses(chunk_id, response): (chunk_id, pos, node_type, attributes, confidence); bare attributes make the first type."""
    r = responses.select("chunk_id", F.from_json(extract_json(F.col("response")), _RESPONSE).alias("r"))
    bare = F.when(F.col("r.attributes").isNotNull(), F.array(F.struct(F.lit(node_types[0]).alias("node_type"), F.col("r.attributes").alias("attributes"))))
    rows = r.select("chunk_id", F.posexplode(F.coalesce("r.nodes", bare)).alias("pos", "n"))
    return rows.where(F.col("n.node_type").isin(*node_types)).select("chunk_id", "pos", "n.node_type", "n.attributes", F.lit(0.85).alias("confidence"))


def edges_from_response(responses: DataFrame, nodes: DataFrame, synonyms: Mapping[str, str]) -> DataFrame:
    """Relations between the first nodes of their types in the same chunk: (chunk_id, relation_type, head, tail positions)."""
    w = Window.partitionBy("chunk_id", "node_type").orderBy("pos")
    first = nodes.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    h = first.select("chunk_id", F.col("node_type").alias("head_type"), F.col("pos").alias("head"))
    t = first.select("chunk_id", F.col("node_type").alias("tail_type"), F.col("pos").alias("tail"))
    r = responses.select("chunk_id", F.explode(F.from_json(extract_json(F.col("response")), _RESPONSE)["relations"]).alias("x")).select("chunk_id", "x.*")
    rows = r.join(h, ["chunk_id", "head_type"]).join(t, ["chunk_id", "tail_type"])
    return rows.select("chunk_id", map_synonyms(F.col("relation_type"), synonyms).alias("relation_type"), "head", "tail", F.lit(0.8).alias("confidence")).distinct()


def render_prompts(templates: DataFrame, contexts: DataFrame) -> DataFrame:
    """templates(scenario, ord, content); contexts(id, scenario, variables map): the filled sections by line."""
    from kgflow.functions.text import render

    rows = contexts.join(templates, "scenario").select("id", "ord", render(F.col("content"), F.col("variables")).alias("line"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("prompt"))


def extract_chunks(
    chunks: DataFrame,
    mappings: Mapping[str, Sequence[NodeMapping]],
    patterns: Mapping[str, Sequence[tuple[str, str, str]]],
    lexicons: Mapping[str, tuple[str, Sequence[str]]] | None = None,
    responses: DataFrame | None = None,
    response_types: Mapping[str, Sequence[str]] | None = None,
    sections: Mapping[tuple[str, str], str] | None = None,
    extractors: Mapping[str, Callable[[], Find]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """chunks(chunk_id, document_type, file_type, text, metadata): (nodes, rejects).

    Records go through the mapping of their document type.  Texts go through its patterns
    and, besides, its lexicon (node type and terms) or the responses(chunk_id, response)
    of a model, from which ``response_types`` keeps node types.  A chunk whose metadata
    name a section goes by ``sections`` of (document type, section_id) instead: 'regex',
    'response' or 'none'.  ``extractors`` are Python of the user's for texts of a document type,
    besides its other routes (``kgflow.operators.extractors``).  Chunks without any route are rejected.
    """
    from kgflow.operators.lexicon import normalise, terms_in
    from kgflow.operators.segment import regex_extract_nodes

    lexicons, response_types, extractors = lexicons or {}, response_types or {}, extractors or {}
    section = F.try_element_at("metadata", F.lit("section_id"))
    plan = F.lit(None).cast("string")
    for (kind, name), how in (sections or {}).items():
        plan = F.when((F.col("document_type") == kind) & (section == name), how).otherwise(plan)
    is_json, kind = F.col("file_type") == "json", F.col("document_type")
    by_section = section.isNotNull()
    allow = lambda names, how: kind.isin(*names) & F.when(by_section, plan == how).otherwise(~is_json)
    routed = {
        "json": ~by_section & is_json & kind.isin(*mappings), "regex": allow(patterns, "regex"),
        "lexicon": ~by_section & ~is_json & kind.isin(*lexicons), "response": allow(response_types, "response"),
        "user": ~by_section & ~is_json & kind.isin(*extractors),
    }
    rows = chunks.select("*", *[F.coalesce(c, F.lit(False)).alias(f"__{r}") for r, c in routed.items()])
    parts = []
    for name, maps in mappings.items():
        own = rows.where(F.col("__json") & (kind == name)).select("chunk_id", F.col("text").alias("json"), "metadata")
        parts.append(map_json_nodes(own, maps).select("chunk_id", "node_type", "attributes"))
    for name, pats in patterns.items():
        own = rows.where(F.col("__regex") & (kind == name)).select(F.col("chunk_id").alias("doc_id"), "text")
        n = regex_extract_nodes(own, pats).dropDuplicates(["doc_id", "node_type", "attribute", "value"])
        parts.append(n.select(F.col("doc_id").alias("chunk_id"), "node_type", F.create_map("attribute", "value").alias("attributes")))
    for name, (node_type, terms) in lexicons.items():
        own = rows.where(F.col("__lexicon") & (kind == name)).select(F.col("chunk_id").alias("doc_id"), "text")
        n = terms_in(normalise(own), terms)
        parts.append(n.select(F.col("doc_id").alias("chunk_id"), F.lit(node_type).alias("node_type"), F.create_map(F.lit("term"), "term").alias("attributes")))
    for name, types in response_types.items():
        own = responses.join(rows.where(F.col("__response") & (kind == name)).select("chunk_id"), "chunk_id", "left_semi")
        parts.append(nodes_from_response(own, types).select("chunk_id", "node_type", "attributes"))
    for name, make in extractors.items():
        parts.append(extract_nodes(rows.where(F.col("__user") & (kind == name)), make))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    lost = ~F.col("__user") & ~F.col("__json") & ~F.col("__regex") & ~F.col("__lexicon") & ~F.col("__response")
    return out, rows.where(lost).select("chunk_id", F.lit("no extractor").alias("reason"))
