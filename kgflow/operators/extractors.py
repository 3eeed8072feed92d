"""Extractors that users bring: Python that turns a text into nodes, run as a table function of Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: What a factory makes, once in each task: a function of a text and its metadata that gives (node_type, attributes).
Find = Callable[[str, Mapping[str, str]], Iterable[tuple[str, Mapping[str, object]]]]

_NODE = StructType().add("node_type", StringType()).add("attributes", MapType(StringType(), StringType()))


def _row(found: tuple[str, Mapping[str, object]]) -> tuple[str, dict[str, str | None]]:
    return found[0], {k: None if v is None else str(v) for k, v in found[1].items()}


def table_function(make: Callable[[], Find]):
    """A table function of (text, metadata), for lateral joins in DataFrames or, once registered, in SQL.

    ``make`` runs once in each task, so that is where a model is loaded.  A null text gives no nodes.
    """

    class Extract:
        @staticmethod
        def analyze(text: AnalyzeArgument, metadata: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(text.dataType, StringType) or not isinstance(metadata.dataType, MapType):
                raise ValueError("an extractor takes a text and a map of metadata")
            return AnalyzeResult(schema=_NODE)

        def __init__(self):
            self.find = make()

        def eval(self, text, metadata):
            if text is not None:
                yield from map(_row, self.find(text, metadata or {}))

    return F.udtf(Extract)


def document_function(make: Callable[[], Find]):
    """A table function of a table of (group, text, metadata) that is partitioned by group and ordered.

    ``make`` runs once in each group, so what it makes may remember the texts before; if it has a method ``finish``, that
    gives nodes once the group has ended.  Rows come one by one, and none is kept here.
    """

    class Extract:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(schema=StructType([f for f in rows.dataType.fields if f.name == "group"] + _NODE.fields))

        def __init__(self):
            self.find, self.group = make(), None

        def eval(self, row: Row):
            self.group = row["group"]
            if row["text"] is not None:
                for found in self.find(row["text"], row["metadata"] or {}):
                    yield (self.group, *_row(found))

        def terminate(self):
            for found in getattr(self.find, "finish", lambda: ())():
                yield (self.group, *_row(found))

    return F.udtf(Extract)


def extract_nodes(chunks: DataFrame, make: Callable[[], Find]) -> DataFrame:
    """chunks(chunk_id, text, metadata): (chunk_id, node_type, attributes), a row for each node that the extractor finds."""
    found = table_function(make)(F.col("text").outer(), F.col("metadata").outer())
    return chunks.select("chunk_id", "text", "metadata").lateralJoin(found).select("chunk_id", "node_type", "attributes")


def extract_by_document(chunks: DataFrame, make: Callable[[], Find], order: str = "chunk_id") -> DataFrame:
    """chunks(source_file, text, metadata, order): (source_file, node_type, attributes); one extractor sees a document's chunks in order."""
    rows = chunks.select(F.col("source_file").alias("group"), "text", "metadata", F.col(order).alias("at"))
    found = document_function(make)(rows.asTable().partitionBy("group").orderBy("at"))
    return found.select(F.col("group").alias("source_file"), "node_type", "attributes")
