"""Set operations of graph construction: united extractions, shared texts, what is left to do, distinct values, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_extractions(*parts: DataFrame) -> DataFrame:
    """All rows of the extractions, repeats included; a column that a part lacks is NULL there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def intersect_texts(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """The distinct texts that both tables have."""
    return a.select(text).intersect(b.select(text))


def except_processed(items: DataFrame, ledger: DataFrame, key: str, stage: str) -> DataFrame:
    """The distinct keys of items that the ledger does not have as done in a stage."""
    done = ledger.where((F.col("stage") == stage) & (F.col("status") == "done"))
    return items.select(key).subtract(done.select(key))


def distinct_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group the sorted array of its distinct values; copies go before the shuffle."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"))


def priority(column: Column, default: int = 999) -> Column:
    """The priority of a type, ``default`` where none is set."""
    return F.coalesce(column, F.lit(default))


def type_priority(types: DataFrame, default: int = 999) -> DataFrame:
    """types(node_type, priority): in the order in which types are processed, with the priority that counts; ties by name."""
    return types.withColumn("priority", priority(F.col("priority"), default)).orderBy("priority", "node_type")


def dup_order(groups: DataFrame, key: str) -> DataFrame:
    """Groups of duplicates (key, n, ...), the largest first; ties by key."""
    return groups.where("n > 1").orderBy(F.desc("n"), key)
