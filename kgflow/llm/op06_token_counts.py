"""Token counts as delta-maintained rollups.

A batch of changes - inserts, deletes, revised counts - becomes signed sums by source,
language and tokenizer version, and is committed under its batch number.  Current totals
are a compacted total and the deltas committed since, so neither a batch nor a look at
the totals scans what was counted before.

Tokens are those of BPE vocabularies.  No token reaches across the words that a text is
split into, so each distinct word is encoded once, for all documents, and its lengths come
back to where it stands.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.llm.common import Scratch, drop_path, scratch_path, table
from kgflow.llm.op01_bpe import token_counts

KEYS = ("source", "lang", "tokenizer")
#: Tokenizer versions: files of the tokenizers library whose tokens span no white space but runs of it.
TOKENIZERS = ("byte_bpe_50k", "word_bpe_49k")
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed_deltas(changes: DataFrame) -> DataFrame:
    """changes(op, source, lang, tokenizer, tokens, old_tokens): the signed sums of one batch.

    op 'insert' adds a document and its tokens, 'delete' takes them away, 'revise' adds
    tokens - old_tokens and no document.  Null counts are 0; null keys are a group;
    any other op changes nothing.  Rows that repeat count each.
    """
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    n = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("op") == "revise", new - old).otherwise(new * n)
    sums = changes.groupBy(*KEYS).agg(F.sum(n).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))
    return sums.select(*[F.col(k).cast("string").alias(k) for k in KEYS], "n_docs", "n_tokens")


def _netted(sums: DataFrame) -> DataFrame:
    total = sums.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return total.where("n_docs <> 0 OR n_tokens <> 0")


class TokenRollup:
    """Totals below ``root``, a folder that driver and executors share.

    Deltas are written first, each to a folder of its own; a small file of the batch's
    name, moved into place by a rename that fails if there is one, is the commit.  So of
    two drivers that commit one batch at once, one wins and the other gets False, and a
    batch that broke off before leaves nothing that counts.  Compactions are numbered and
    committed alike; each tells the batches that it holds.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs_of = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._fs_of.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _claim(self, name: str, content: dict) -> bool:
        """Puts a file in place, whole and only if it is not there."""
        gateway, draft = self.spark.sparkContext._gateway, self._path(f"drafts/{uuid.uuid4().hex}")
        out = self._fs().create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._fs().mkdirs(self._path(name).getParent())
        context = self._fs_of.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, self._path(name), gateway.new_array(getattr(self._fs_of, "Options$Rename"), 0))
        except Exception:
            self._fs().delete(draft, False)
            if self._fs().exists(self._path(name)):
                return False
            raise
        return True

    def _claims(self, kind: str) -> dict[int, dict]:
        """The committed files of a kind by number: one a batch or compaction, so few."""
        fs, folder = self._fs(), self._path(kind)
        if not fs.exists(folder):
            return {}
        names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        out = {}
        for p in names:
            stream = fs.open(p)
            out[int(p.getName())] = json.loads(read.toString(stream, "UTF-8"))
            stream.close()
        return out

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies a batch once: a batch number that is committed already changes nothing and gives False."""
        if self._fs().exists(self._path(f"batches/{int(batch)}")):
            return False
        path = f"{self.root}/deltas/{uuid.uuid4().hex}"
        signed_deltas(changes).write.parquet(path)
        if self._claim(f"batches/{int(batch)}", {"path": path}):
            return True
        drop_path(self.spark, path)
        return False

    def _state(self) -> tuple[int, dict | None, dict[int, dict]]:
        """Number and content of the last compaction, and the batches committed since."""
        totals, batches = self._claims("totals"), self._claims("batches")
        last = max(totals, default=0)
        held = set(totals[last]["batches"]) if last else set()
        return last, totals.get(last), {b: c for b, c in batches.items() if b not in held}

    def totals(self) -> DataFrame:
        """Current totals by source, lang and tokenizer; groups that have come to nothing are absent; none before the first commit."""
        _, total, since = self._state()
        paths = [c["path"] for c in since.values()] + ([total["path"]] if total else [])
        return _netted(self.spark.read.schema(_DELTA).parquet(*paths)) if paths else self.spark.createDataFrame([], _DELTA)

    def compact(self) -> bool:
        """Folds the batches committed since the last compaction into the total; False if there are none, or another driver was first."""
        last, total, since = self._state()
        if not since:
            return False
        path = f"{self.root}/compacted/{uuid.uuid4().hex}"
        self.totals().write.parquet(path)
        if self._claim(f"totals/{last + 1}", {"path": path, "batches": sorted([*since, *(total["batches"] if total else [])])}):
            return True
        drop_path(self.spark, path)
        return False


def count_tokens(docs: DataFrame, tokenizers: Sequence[str] = TOKENIZERS, folder: Callable[[str], str] | None = None) -> DataFrame:
    """docs(doc_id, source, lang, text): doc_id, source, lang and one count column per tokenizer version.

    A null or empty text counts 0; very long texts are counted whole; every row comes out once.
    ``folder`` gives the file of a tokenizer from its name with the ending .json.
    """
    if folder is None:
        from public_tokenizers import path as folder
    tag = F.to_json(F.struct(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")))
    with Scratch(docs.sparkSession) as scratch:
        counted = token_counts(docs.select("doc_id", "text", tag.alias("tag")), [folder(f"{t}.json") for t in tokenizers], scratch)
        of = F.from_json("tag", "source string, lang string")
        return scratch.keep(counted.select("doc_id", of["source"].alias("source"), of["lang"].alias("lang"), *[F.get("counts", F.lit(i)).alias(t) for i, t in enumerate(tokenizers)]), "token-counts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: all are inserted under both versions; those labelled toxic
    are deleted, in a batch that comes twice, as after a retry, and counts once; the counts of those
    labelled of low quality and not toxic are revised to include an end-of-text token under the
    first version.  The first two batches are compacted."""
    first = TOKENIZERS[0]
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    counts = count_tokens(table(spark, sf_dir, "documents"))
    none = F.lit(None).cast("long")

    def changes(op: str, rows: DataFrame) -> DataFrame:
        versions = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(v).alias("tokens")) for v in TOKENIZERS])).alias("v")
        return rows.select("source", "lang", versions).select(F.lit(op).alias("op"), "source", "lang", "v.tokenizer", "v.tokens", none.alias("old_tokens"))

    known = counts.join(labels, "doc_id", "left")
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    rollup.commit(1, changes("insert", counts))
    for _ in range(2):
        rollup.commit(2, changes("delete", known.where("toxic = 1")))
    rollup.compact()
    low = known.where("quality = 0 AND coalesce(toxic, 0) <> 1")
    rollup.commit(3, low.select(F.lit("revise").alias("op"), "source", "lang", F.lit(first).alias("tokenizer"), (F.col(first) + 1).alias("tokens"), F.col(first).alias("old_tokens")))
    return rollup.totals()
