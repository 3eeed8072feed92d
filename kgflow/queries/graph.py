"""The property graph that the queries see in the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.functions.intervals import parse_interval


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KINDS = (("c", "customer", "c_custkey", "c_name"), ("o", "orders", "o_orderkey", "o_orderstatus"), ("p", "part", "p_partkey", "p_name"), ("s", "supplier", "s_suppkey", "s_name"), ("n", "nation", "n_nationkey", "n_name"), ("r", "region", "r_regionkey", "r_name"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, node_type, attributes."""
    out = None
    for letter, name, key, label in _KINDS:
        n = table(spark, sf_dir, name).select(F.concat(F.lit(letter), key).alias("node_id"), F.lit(name).alias("node_type"), F.create_map(F.lit("name"), F.col(label)).alias("attributes"))
        out = n if out is None else out.union(n)
    return out


#: Lines for each task that makes distinct edges of them.
LINE_BLOCK = 250_000


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation_type, head, tail, confidence.  Pairs of keys that repeat are dealt by the head, in tasks that grow with the table,
    and become distinct before they are strings."""

    def edge(name, relation, h, t, confidence, distinct=False):
        e = table(spark, sf_dir, name).select(h[1], t[1])
        e = e.repartition(tasks, h[1]).distinct() if distinct else e
        e = e.select(F.concat(F.lit(h[0]), h[1]).alias("head"), F.concat(F.lit(t[0]), t[1]).alias("tail"))
        return e.select(F.lit(relation).alias("relation_type"), "head", "tail", F.lit(confidence).alias("confidence"))

    tasks = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINE_BLOCK))
    return (
        edge("orders", "PLACED", ("c", "o_custkey"), ("o", "o_orderkey"), 0.9)
        .union(edge("lineitem", "CONTAINS", ("o", "l_orderkey"), ("p", "l_partkey"), 0.8, True))
        .union(edge("lineitem", "SUPPLIED_BY", ("o", "l_orderkey"), ("s", "l_suppkey"), 0.7, True))
        .union(edge("customer", "IN_NATION", ("c", "c_custkey"), ("n", "c_nationkey"), 1.0))
        .union(edge("supplier", "IN_NATION", ("s", "s_suppkey"), ("n", "s_nationkey"), 1.0))
        .union(edge("nation", "IN_REGION", ("n", "n_nationkey"), ("r", "n_regionkey"), 1.0))
    )


SQL_NODES = "g_nodes AS (" + " UNION ALL ".join(f"SELECT '{x}' || {k} AS node_id, '{n}' AS node_type, {v} AS name FROM {n}" for x, n, k, v in _KINDS) + ")"
SQL_EDGES = """g_edges AS (
SELECT 'PLACED' AS relation_type, 'c' || o_custkey AS head, 'o' || o_orderkey AS tail, 0.9::DOUBLE AS confidence FROM orders
UNION ALL SELECT 'CONTAINS', head, tail, 0.8 FROM (SELECT DISTINCT 'o' || l_orderkey AS head, 'p' || l_partkey AS tail FROM lineitem)
UNION ALL SELECT 'SUPPLIED_BY', head, tail, 0.7 FROM (SELECT DISTINCT 'o' || l_orderkey AS head, 's' || l_suppkey AS tail FROM lineitem)
UNION ALL SELECT 'IN_NATION', 'c' || c_custkey, 'n' || c_nationkey, 1.0 FROM customer
UNION ALL SELECT 'IN_NATION', 's' || s_suppkey, 'n' || s_nationkey, 1.0 FROM supplier
UNION ALL SELECT 'IN_REGION', 'n' || n_nationkey, 'r' || n_regionkey, 1.0 FROM nation)"""


def position_text(key: str = "o_orderkey", cust: str = "o_custkey"):
    end = F.col(key) + F.col(cust) % 50
    return F.concat(F.lit("DK"), F.floor(F.col(key) / 1000), F.lit("+"), F.col(key) % 1000, F.lit("~DK"), F.floor(end / 1000), F.lit("+"), end % 1000)


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, o_orderkey, o_custkey, status and the parsed interval iv of every order."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"), "o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), parse_interval(position_text()).alias("iv"))


SQL_INTERVALS = "g_intervals AS (SELECT 'o' || o_orderkey AS node_id, o_orderkey, o_orderstatus AS status, o_orderkey::DOUBLE AS s, (o_orderkey + o_custkey % 50)::DOUBLE AS e FROM orders)"
