"""Content ids, dense numbers and embeddings of node tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgflow.operators.joins import unprocessed
from kgflow.sources.manifest import claim_numbers
from kgflow.sources.scratch import written


def content_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def rank_by_hash(rows: DataFrame, order: str, keys: Sequence[str] = (), tie: str | None = None, digits: int = 4) -> DataFrame:
    """Adds ``rank``, dense from 1 within keys in the order of hexadecimal digests, and ``rank_of``, the number of rows.

    Digests fall into buckets by their first digits; each is ranked by itself and moved by what stands
    before it, so no task sorts all rows of a key.
    """
    b = rows.withColumn("__b", F.substring(order, 1, digits))
    w = Window.partitionBy(*keys)
    counts = b.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))  # at most 16 ** digits rows for a key
    before = F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__b").alias("__at"), before.alias("__off"), F.sum("__n").over(w).alias("rank_of"))
    own = b.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(order, *([tie] if tie else []))))
    same = F.col("__b") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return own.join(offsets, same).select(*rows.columns, (F.col("__off") + F.col("__rn")).alias("rank"), "rank_of")


def number_rows(rows: DataFrame, id_col: str, prefix: str, ledger: str | None = None) -> DataFrame:
    """Adds number, dense from 1 in the order of hexadecimal ids, and a label of it, six digits or more.

    With a ``ledger`` (a folder that drivers share) the rows are counted, and take that many numbers which no run that
    uses the ledger has had or will have: dense within a run, in the order of the runs' claims.
    """
    before = 0
    if ledger:
        before = claim_numbers(rows.sparkSession, ledger, n) - 1 if (n := rows.count()) else 0
    numbered = rank_by_hash(rows, id_col).withColumn("number", F.col("rank") + F.lit(before)).drop("rank", "rank_of")
    digits = F.col("number").cast("string")
    return numbered.withColumn("label", F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))))


def hashed_embedding(rows: DataFrame, id_col: str, text_col: str, dims: int = 32) -> DataFrame:
    """(id, embedding): counts of hashed words of any script, of unit length; zeros for a text without words.  It stands in for a model."""
    words = rows.select(id_col, F.explode_outer(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    dim = F.conv(F.substring(F.md5("w"), 1, 6), 16, 10).cast("int") % dims
    counts = words.groupBy(id_col, dim.alias("dim")).agg(F.count("w").alias("n"))
    m = counts.groupBy(id_col).agg(F.map_from_entries(F.filter(F.collect_list(F.struct("dim", "n")), lambda e: e["dim"].isNotNull())).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return m.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_divide(F.try_element_at("m", i).cast("double"), F.col("norm")), F.lit(0.0))).alias("embedding"))


def embed_table(nodes: DataFrame, done: DataFrame, text_col: str, embed: Callable[[DataFrame, str, str], DataFrame] = hashed_embedding, force: bool = False) -> DataFrame:
    """Embeddings of the nodes that the ledger does not have as embedded, or of all under ``force``.

    ``embed`` is a function of tables, such as one that applies a user's model with mapInPandas.
    """
    return embed(unprocessed(nodes, done, "node_id", "embed", force), "node_id", text_col)


#: A model: vectors of texts, in their order.
Model = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed_batches(nodes: DataFrame, done: DataFrame, text_col: str, load: Callable[[], Model], dims: int, batch: int = 32, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node_id, embedding of the nodes that the ledger does not have as embedded; node_id, reason of those that failed).

    ``load`` runs once in each task; its model gets ``batch`` texts at a time.  Where a batch raises, its texts are tried
    one by one, so that only those go to the rejects that fail alone; so do vectors that have not ``dims`` numbers.
    A null or empty text is a reject that no model sees.  Rejects are not in the ledger, so a later run tries them
    again.  The result is written once, in shared scratch space, and both tables read it.
    """

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def told(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
            try:
                vectors = [[float(x) for x in v] for v in model(texts)]
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            except Exception as e:
                if len(texts) > 1:
                    return [told([t])[0] for t in texts]
                return [(None, f"{type(e).__name__}: {e}")]
            return [(v, None) if len(v) == dims else (None, f"{len(v)} numbers instead of {dims}") for v in vectors]

        for pdf in batches:
            full = pdf[pdf["text"].fillna("") != ""]
            rows = [(i, None, "no text") for i in pdf.loc[~pdf.index.isin(full.index), "node_id"]]
            for at in range(0, len(full), batch):
                part = full.iloc[at : at + batch]
                rows += [(i, v, reason) for i, (v, reason) in zip(part["node_id"], told(part["text"].tolist()), strict=True)]
            yield pd.DataFrame(rows, columns=["node_id", "embedding", "reason"], dtype=object)

    rows = unprocessed(nodes, done, "node_id", "embed", force).select("node_id", F.col(text_col).alias("text"))
    made = written(rows.mapInPandas(embedded, f"node_id {dict(rows.dtypes)['node_id']}, embedding array<double>, reason string"), "embedded")
    return made.where("reason IS NULL").drop("reason"), made.where("reason IS NOT NULL").drop("embedding")
