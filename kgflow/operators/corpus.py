"""Labelled corpora: dedup, balance, split, reports and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgflow.operators.embed import rank_by_hash


def scan_labeled_lines(lines: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """lines(value, keep ...) ``<text> <int>``, cut at the last space: (rows of text, label and keep; rejected lines)."""
    pattern = r"(?s)^(.*) (-?\d+)$"
    ok = lines.where(F.col("value").rlike(pattern))
    rows = ok.select(F.regexp_extract("value", pattern, 1).alias("text"), F.regexp_extract("value", pattern, 2).cast("int").alias("label"), *keep)
    return rows, lines.where(~F.coalesce(F.col("value").rlike(pattern), F.lit(False)))


def corpus_dedup(rows: DataFrame) -> DataFrame:
    """The first row (by ord) of each text, and whether its copies have other labels."""
    return rows.groupBy("text").agg(F.min("ord").alias("ord"), F.min_by("label", "ord").alias("label"), (F.count_distinct("label") > 1).alias("conflict"))


def hash_order(text: str, seed: str) -> Column:
    """An order that is random, yet the same wherever and however often it is computed."""
    return F.md5(F.concat(F.col(text), F.lit(seed)))


def corpus_balance(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """n rows of each label by hash order, all if there are fewer."""
    w = Window.partitionBy("label").orderBy(hash_order("text", seed), "text")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def stratified_split(rows: DataFrame, seed: str, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Adds split: per label round(n * train) rows, round(n * val) rows and the rest, halves rounded to even."""
    ranked = rank_by_hash(rows.withColumn("__h", hash_order("text", seed)), "__h", ["label"], "text").drop("__h")
    a, b = F.bround(F.col("rank_of") * F.lit(train), 0), F.bround(F.col("rank_of") * F.lit(val), 0)
    split = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("rank", "rank_of")


def leakage_check(split: DataFrame) -> DataFrame:
    """Texts that are in more than one split."""
    return split.groupBy("text").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def split_report(split: DataFrame) -> DataFrame:
    """Counts per split and label, per split, and in all."""
    return split.rollup("split", "label").agg(F.count("*").alias("n"))


def confusion_metrics(rows: DataFrame) -> DataFrame:
    """rows(label, predicted of 0/1): counts and rates, 0 where a rate has no denominator."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y, p = F.col("label") == 1, F.col("predicted") == 1
    c = rows.agg(one(y & p).alias("tp"), one(~y & p).alias("fp"), one(y & ~p).alias("fn"), one(~y & ~p).alias("tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumn("accuracy", rate(F.col("tp") + F.col("tn"), F.expr("tp + fp + fn + tn")))
    c = c.withColumn("precision", rate(F.col("tp"), F.expr("tp + fp"))).withColumn("recall", rate(F.col("tp"), F.expr("tp + fn")))
    return c.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def prepare_tag_corpus(lines: DataFrame, tags: list[str], max_len: int) -> tuple[DataFrame, DataFrame]:
    """lines(value) of JSON ``{"text", "labels"}``: (rows of chars, labels, mask; rejects by reason).

    Text and labels are cut to the shorter of them and max_len - 2; an unknown tag becomes O.
    """
    parsed = lines.select("value", F.from_json("value", "text string, labels array<string>", {"mode": "PERMISSIVE"}).alias("r"))
    reason = F.when(F.col("r").isNull() | (F.col("r.text").isNull() & F.col("r.labels").isNull()), "not json").when(F.coalesce(F.col("r.text"), F.lit("")) == "", "no text").when(F.col("r.labels").isNull(), "no labels")
    parsed = parsed.withColumn("reason", reason)
    n = F.least(F.length("r.text"), F.size("r.labels"), F.lit(max_len - 2))
    labels = F.transform(F.slice("r.labels", F.lit(1), n), lambda t: F.when(t.isin(*tags), t).otherwise("O"))
    ok = parsed.where("reason IS NULL").select(F.split(F.left("r.text", n), "").alias("chars"), labels.alias("labels"), F.array_repeat(F.lit(1), n).alias("mask"))
    return ok, parsed.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def lexicon_from_labels(corpus: DataFrame) -> DataFrame:
    """corpus(doc_id, chars, labels): (term, tag, n) of the runs that a B- tag begins and I- tags go on.

    The runs of a batch of rows are cut from its characters at once: no character becomes a row of a shuffle.
    """

    @F.arrow_udf("array<struct<term:string,tag:string>>")
    def runs(rows: pa.Array) -> pa.Array:
        flat = rows.flatten()
        chars, labels = (pc.fill_null(pc.struct_field(flat, [k]), "").cast(pa.string()) for k in (0, 1))
        row = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
        on, begins = (pc.starts_with(labels, p).to_numpy(zero_copy_only=False) for p in ("I-", "B-"))
        fresh = ~on | (np.diff(row, prepend=-1) != 0)
        start = np.flatnonzero(fresh)
        terms = begins[start]
        if not terms.any():
            return pa.array([[]] * len(rows), pa.list_(pa.struct([("term", pa.string()), ("tag", pa.string())])))
        picked = chars.filter(pa.array(terms[np.cumsum(fresh) - 1]))
        cuts = np.concatenate([[0], np.cumsum(np.diff(start, append=len(row))[terms])])
        offsets = np.frombuffer(picked.buffers()[1], np.int32, len(picked) + 1, 4 * picked.offset)
        text = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(offsets[cuts].copy()), picked.buffers()[2])
        tags = pc.utf8_slice_codeunits(labels.take(pa.array(start[terms])), 2)
        held = np.bincount(row[start[terms]], minlength=len(rows))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), pa.StructArray.from_arrays([text, tags], ["term", "tag"]))

    found = corpus.select(F.inline(runs(F.arrays_zip("chars", "labels"))))
    return found.groupBy("term", "tag").agg(F.count("*").alias("n"))


def fusion_loss(rows: DataFrame, penalty: float = 0.05) -> DataFrame:
    """rows(alpha, beta, key_score, semantic): mean of 1 - fused score + penalty * entropy of the weights."""
    log = lambda c: F.col(c) * F.log(F.greatest(F.col(c), F.lit(1e-12)))
    return rows.agg(F.avg(1 - (F.col("alpha") * F.col("key_score") + F.col("beta") * F.col("semantic")) - penalty * (log("alpha") + log("beta"))).alias("loss"))
