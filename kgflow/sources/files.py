"""Files, tables and the ledger: sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.sources.keyed import KeyedTable


def scan_files(spark: SparkSession, root: str, glob: str, recursive: bool = True) -> DataFrame:
    """(source_file, length, modified) of the files below a folder, without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select(F.col("path").alias("source_file"), "length", F.col("modificationTime").alias("modified"))


def sink_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("document_type", "file_type").parquet(path)


def sink_summary(chunks: DataFrame) -> DataFrame:
    """Chunks per document and file type, per document type, and in all."""
    return chunks.rollup("document_type", "file_type").agg(F.count("*").alias("n"))


def sink_graph(table: KeyedTable, changes: DataFrame, most: int = 8) -> None:
    """Upserts changes (ordered by ord) by key: files of the buckets that they touch are added, others stay."""
    table.upsert(changes)
    table.compact(most)


def sink_training_split(rows: DataFrame, path: str) -> None:
    """rows(text, label, split): text files of lines ``<text> <label>``, a folder a split; line feeds in a text become spaces."""
    line = F.concat_ws(" ", F.regexp_replace("text", r"[\r\n]+", " "), F.col("label").cast("string"))
    rows.select("split", line.alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def scan_extraction_results(tiers: DataFrame) -> DataFrame:
    """tiers(source_file, tier, ...): per file all rows of its best tier, 1 before 2 before 3."""
    best = tiers.groupBy("source_file").agg(F.min("tier").alias("tier"))
    return tiers.join(best, ["source_file", "tier"])


def purge_results(results: DataFrame, document_type: str) -> DataFrame:
    """Results without one document type, whose files are then unprocessed again."""
    return results.where(~F.col("document_type").eqNullSafe(F.lit(document_type)))
