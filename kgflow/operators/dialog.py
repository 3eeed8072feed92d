"""Feedback classification and the recommendation dialog as a fold over a conversation's turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_rejection(text: Column, keywords: Sequence[str]) -> Column:
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(text, F.lit(k))
    return F.coalesce(found, F.lit(False))


def classify_feedback(text: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """struct(reason, keyword, confidence): the first group that has a keyword in the text; 0.8 if it is the only one, else 0.6; 0 for none."""
    hits = [F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in words], F.lit(None).cast("string")) for _, words in groups]
    reason = F.coalesce(*[F.when(h.isNotNull(), F.lit(name)) for (name, _), h in zip(groups, hits, strict=True)], F.lit("other"))
    n = F.lit(0)
    for h in hits:
        n = n + h.isNotNull().cast("int")
    confidence = F.when(n == 0, 0.0).when(n == 1, 0.8).otherwise(0.6)
    return F.struct(reason.alias("reason"), F.coalesce(*hits).alias("keyword"), confidence.alias("confidence"))


def feedback_suggestions(classified: DataFrame, suggestions: DataFrame) -> DataFrame:
    """suggestions(reason, items array): adds a numbered list of what to do."""
    numbered = F.array_join(F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return classified.join(suggestions.select("reason", numbered.alias("summary")), "reason", "left")


def detect_topic_change(turns: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Adds changed: some slot differs from the turn before; false in the first turn.  Slots that are sets come as sorted arrays."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    changed = F.lit(False)
    for s in slots:
        changed = changed | ~F.col(s).eqNullSafe(F.lag(s).over(w))
    return turns.withColumn("changed", (F.row_number().over(w) > 1) & changed)


def next_state(acc: Column, turn: Column, max_rejections: int = 3) -> Column:
    """One turn of the dialog; acc and the result are struct(state, idx, rejections, plans).

    kind 'query' with n_plans begins a search where the dialog is idle or completed; 'change' begins one from
    anywhere but the refused state; 'accept' and 'reject' act on the plan shown; other kinds are follow-ups.
    In the refused state any message only brings up the next plan.
    """

    def st(state, idx, rejections, plans):
        return F.struct(state.alias("state"), idx.cast("int").alias("idx"), rejections.cast("int").alias("rejections"), plans.cast("int").alias("plans"))

    zero, kind = F.lit(0), turn["kind"]
    begun = st(F.when(turn["n_plans"] > 0, "PRESENTING").otherwise("COMPLETED"), zero, zero, turn["n_plans"])
    n = acc["rejections"] + 1
    ended = (n >= max_rejections) | (acc["idx"] >= acc["plans"] - 1)
    rejected = st(F.when(ended, "COMPLETED").otherwise("REFUSED"), F.when(ended, acc["idx"]).otherwise(acc["idx"] + 1), n, acc["plans"])
    presenting = acc["state"] == "PRESENTING"
    return (
        F.when(acc["state"] == "REFUSED", st(F.lit("PRESENTING"), acc["idx"], acc["rejections"], acc["plans"]))
        .when(acc["state"].isin("IDLE", "COMPLETED") | (kind == "change"), begun)
        .when(presenting & (kind == "accept"), st(F.lit("COMPLETED"), acc["idx"], acc["rejections"], acc["plans"]))
        .when(presenting & (kind == "reject"), rejected)
        .otherwise(acc)
    )


INITIAL = "struct<state:string,idx:int,rejections:int,plans:int>"


def dialog_state(turns: DataFrame, max_rejections: int = 3) -> DataFrame:
    """turns(conv_id, turn, kind, n_plans): the state after the last turn of each conversation."""
    start = F.struct(F.lit("IDLE").alias("state"), F.lit(0).alias("idx"), F.lit(0).alias("rejections"), F.lit(0).alias("plans"))
    seq = F.array_sort(F.collect_list(F.struct("turn", "kind", F.col("n_plans").cast("int").alias("n_plans"))))
    folded = turns.groupBy("conv_id").agg(F.aggregate(seq, start, lambda a, t: next_state(a, t, max_rejections)).alias("s"), F.count("*").alias("n_turns"))
    return folded.select("conv_id", "n_turns", "s.state", "s.idx", "s.rejections", "s.plans")
