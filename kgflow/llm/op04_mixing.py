"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws an exponential key, -ln(u) / quality weight, from a hash of its
id.  A source takes whole epochs of all its documents first; the rest of its token
budget goes to its smallest keys.  The prefix sum runs over key buckets, which are
summed before they are shuffled, and only the bucket in which the budget ends is
sorted row by row: a source with a third of all rows is never in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgflow.llm.common import WORD_PATTERN, Scratch, table

SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2
#: Key buckets of a source: the rows of one, a 16,384th of a source or so, are sorted in a task.
BUCKETS = 1 << 14
SEED = "mix-1"


def n_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def sampling_key(id_col: str, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from the first 52 bits of an md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.floor((1 - F.exp(-key)) * buckets).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float] = SOURCE_WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes(source, source_size): adds target.  One row per source, so the global order below is over few rows.

    Weights repeat over the sources in code point order, null last.  Targets stop at
    ``most`` times the size; what is above is shared again by weight.  The level where
    that ends is found at once: with sources ordered by cap / weight, it is the first
    position at which the level of the rest does not exceed the next cap.
    """
    everyone = Window.partitionBy()
    ordered = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (ordered % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("level", (F.sum("source_size").over(everyone) * share - before) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("place", F.row_number().over(by_cap))
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    rows = rows.withColumn("level", F.min_by("level", F.when(fits, F.col("place"))).over(everyone))
    target = F.when(F.col("cap") / F.col("weight") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return rows.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, scratch: Scratch, weights: Sequence[float] = SOURCE_WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """sized(doc_id, source, size, key): one row per source with its target and where its fractional epoch ends.

    The fractional epoch takes keys in order while they fit.  What the budget still
    lacks then is filled by the one remaining document that comes nearest to it.
    """
    rows = sized.withColumn("bucket", bucket_of(F.col("key"), buckets))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sources = scratch.write(sources, "mix-sources")  # a table whose size Spark knows when it picks the joins below
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sums.withColumn("upto", F.sum("bucket_size").over(by_bucket))
    upto = upto.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("upto > rest")
    ends = upto.groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("bucket_size")).alias("before"))).alias("end"))
    plan = sources.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "epochs", "rest", F.col("end.bucket").alias("end_bucket"), F.coalesce("end.before", F.lit(0)).alias("before")
    )
    p = plan.withColumnRenamed("source", "s")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id")
    last = rows.join(p.where("end_bucket IS NOT NULL"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("end_bucket")))
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(within))
    last = last.where("upto <= rest").groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("cutoff"), F.max("upto").alias("upto"))
    plan = plan.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = scratch.write(plan.withColumn("gap", F.col("rest") - F.coalesce("upto", "before")), "mix-plan")
    p = plan.withColumnRenamed("source", "s")
    left = rows.join(p, F.col("source").eqNullSafe(F.col("s"))).where(~_in_epoch() & (F.abs(F.col("gap") - F.col("size")) < F.col("gap")))
    extra = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), "key", "doc_id")).alias("extra"))
    plan = plan.join(extra.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    plan = plan.select("source", "source_size", "target", "epochs", "rest", "end_bucket", "cutoff", F.struct("extra.key", "extra.doc_id").alias("extra"))
    return scratch.write(plan, "mix-plan")


def _in_epoch() -> Column:
    """Whether a row's key comes before the end of its source's fractional epoch."""
    earlier = F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(False))
    return earlier | F.coalesce((F.col("bucket") == F.col("end_bucket")) & (F.struct("key", "doc_id") <= F.col("cutoff")), F.lit(False))


def apply_plan(sized: DataFrame, plan: DataFrame, most: int = MOST_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """Adds source_size, target, copies and taken to the rows of sized(doc_id, source, size, key, ...); none is copied more than ``most`` times."""
    p = plan.withColumnRenamed("source", "__source")
    rows = sized.withColumn("bucket", bucket_of(F.col("key"), buckets)).join(p, F.col("source").eqNullSafe(F.col("__source")))
    chosen = _in_epoch() | F.coalesce(F.struct("key", "doc_id") == F.col("extra"), F.lit(False))
    copies = F.least(F.col("epochs") + chosen.cast("long"), F.lit(most))
    return rows.select(*sized.columns, "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def sized_documents(docs: DataFrame, labels: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size and key of every document; quality weight 2 where labelled good, 1/2 where bad, else 1."""
    quality = labels.groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    rows = docs.select("doc_id", "source", n_words("text").alias("size")).join(quality, "doc_id", "left")
    weight = F.when(F.col("__quality") == 1, 2.0).when(F.col("__quality") == 0, 0.5).otherwise(1.0)
    return rows.select("doc_id", "source", "size", sampling_key("doc_id", weight, seed).alias("key"))


def mix_sources(docs: DataFrame, labels: DataFrame, weights: Sequence[float] = SOURCE_WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs(doc_id, text, source, ...).

    A null text has size 0, a null source is a source of its own.  Rows of equal id
    share a key and are taken together.  Without rows the result is empty; without
    any words every target is 0.  Reruns agree, whatever the partitions.
    """
    with Scratch(docs.sparkSession) as scratch:
        sized = scratch.write(sized_documents(docs, labels, seed), "mix")
        return scratch.keep(apply_plan(sized, mix_plan(sized, scratch, weights, share, most), most), "mix-result")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             -ln((('0x' || md5('mix-1:' || doc_id)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
               / CASE WHEN quality = 1 THEN 2.0 WHEN quality = 0 THEN 0.5 ELSE 1.0 END AS key
      FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2 AS cap, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER c AS place
      FROM w WINDOW c AS (ORDER BY cap / weight, source NULLS LAST)),
m AS (SELECT min_by(level, place) AS level FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size, CASE WHEN cap / weight < m.level THEN cap::DOUBLE ELSE weight * m.level END AS target FROM l, m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
f AS (SELECT d.doc_id, d.size, d.key, e.*, target - epochs * source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
g AS (SELECT *, rest - coalesce(max(upto) FILTER (upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM f),
x AS (SELECT source, min((abs(gap - size), key, doc_id)) AS extra FROM g WHERE upto > rest AND abs(gap - size) < gap GROUP BY source)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN upto <= rest OR coalesce((key, doc_id) = (struct_extract(extra, 2), struct_extract(extra, 3)), false) THEN 1 ELSE 0 END) AS taken, g.source
FROM g LEFT JOIN x ON g.source IS NOT DISTINCT FROM x.source
"""
