"""Documents to pages, chunks, titled sections and pattern nodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgflow.functions.text import chunk_text
from kgflow.operators.lexicon import automaton, lexicon_match


def scan_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_no, text): the text of each document, blank pages dropped, pages joined by an empty line."""
    full = pages.where(F.length(F.trim("text")) > 0)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n")
    return full.groupBy("doc_id").agg(joined.alias("text"), F.count("*").alias("n_pages"))


def chunk_documents(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """docs(doc_id, text): doc_id, chunk_index, text, char_start, char_end."""
    return docs.select("doc_id", F.posexplode(chunk_text(F.col("text"), size, overlap)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.text", "c.char_start", "c.char_end")


def chunk_pages(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """pages(doc_id, page_no, text): chunks within pages, numbered and placed through the document."""
    parts = pages.select("doc_id", "page_no", F.posexplode(chunk_text(F.col("text"), size, overlap)).alias("i", "c"))
    w = Window.partitionBy("doc_id").orderBy("page_no", "i")
    start = F.coalesce(F.sum(F.length("c.text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("doc_id", "page_no", (F.row_number().over(w) - 1).alias("chunk_index"), F.col("c.text").alias("text"), start.alias("char_start"), (start + F.length("c.text")).alias("char_end"))


def segment_by_titles(docs: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """docs(doc_id, text): (doc_id, section_id, text) cut at the first match of each title pattern.

    The text before the first title is section "0"; a text without any title is one section, NULL."""
    clean = docs.withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("text", "[．、]", "."), r"(?U)\s+", " ")))
    marks = F.array(*[F.struct(F.regexp_instr("text", F.lit(p)).alias("at"), F.lit(k).alias("id")) for k, p in patterns.items()])
    marks = F.array_sort(F.filter(marks, lambda m: m["at"] > 0))
    head = F.when((F.size("marks") > 0) & (F.get("marks", F.lit(0))["at"] > 1), F.array(F.struct(F.lit(1).alias("at"), F.lit("0").alias("id")))).when(F.size("marks") == 0, F.array(F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("id")))).otherwise(F.array().cast("array<struct<at:int,id:string>>"))
    cut = clean.withColumn("marks", marks).withColumn("marks", F.concat(head, F.col("marks")))
    ends = F.transform("marks", lambda m, i: F.struct(m["id"].alias("id"), m["at"].alias("at"), F.coalesce(F.get(F.col("marks"), i + 1)["at"], F.length("text") + 1).alias("end")))
    rows = cut.select("doc_id", "text", F.explode(ends).alias("m"))
    return rows.select("doc_id", F.col("m.id").alias("section_id"), F.trim(F.substring("text", F.col("m.at"), F.col("m.end") - F.col("m.at"))).alias("text"))


def merge_section_text(sections: DataFrame) -> DataFrame:
    """sections(doc_id, section_id, text): one text per document, each section under its heading, in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("section_id", "text"))), lambda s: F.concat(F.lit("["), s["section_id"], F.lit("] "), s["text"]))
    return sections.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("text"))


def regex_extract_nodes(docs: DataFrame, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """docs(doc_id, text), patterns (node_type, attribute, regex): a node of confidence 1 for every match."""

    def matches(node_type: str, attribute: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(node_type).alias("node_type"), F.lit(attribute).alias("attribute"), v.alias("value")))

    found = [matches(*p) for p in patterns]
    return docs.select("doc_id", F.posexplode(F.concat(*found)).alias("pos", "n")).select("doc_id", "pos", "n.node_type", "n.attribute", "n.value", F.lit(1.0).alias("confidence"))


def extract_first(docs: DataFrame, pattern: str) -> DataFrame:
    """The first match in each text, NULL if there is none."""
    return docs.select("doc_id", F.nullif(F.regexp_extract("text", pattern, 0), F.lit("")).alias("value"))


def keyword_nodes(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """docs(doc_id, text), keywords(node_type, keyword): one node for each row and keyword that its text contains.

    An empty keyword is in no text.  A keyword of several types makes a node of each.
    """
    known = automaton(terms := keywords.select(F.col("keyword").alias("term")))
    if known:
        found = docs.select("doc_id", F.explode(known.terms_in(F.col("text"))).alias("keyword"))
    else:
        rows = docs.withColumn("doc_id", F.struct("doc_id", F.monotonically_increasing_id()))
        found = lexicon_match(rows, terms).select("doc_id", F.col("term").alias("keyword")).distinct().select("doc_id.doc_id", "keyword")
    return found.join(keywords, "keyword").select("doc_id", "node_type", "keyword")
