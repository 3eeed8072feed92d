"""Exact dedup by a tree merge of sorted digest runs.

Every input partition makes sorted runs: its texts' digests, each once, with the number
of rows and the identifier to retain.  The runs then meet in rounds of a binomial tree:
in round r, the ``fan_in`` runs whose numbers differ only in digit r exchange pieces, so
that each receives one range of digit r of the digests, and each merges the sorted pieces
it received into one sorted run.  At every level records merge only where digest and a
second fingerprint agree.  After the last round a run holds one range of digests whole.
A text that a third of all rows share is one record of each run from the start, so no
task sees more of it than there are runs to merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.llm.common import Scratch, ascii_lower, join_groups, lean, sql_ascii_lower, table

FAN_IN = 8
#: Rows of an input partition that make one run.
RUN = 1 << 20
#: A record of a run.  The digest is four numbers, read from its bytes first byte highest, so that runs are in the order of its bytes.
RECORD = np.dtype([("digest", "<u8", 4), ("check", "<i8"), ("id", "<i8"), ("known", "?"), ("n", "<i8")])


def collapse(records: np.ndarray, keep: str = "max") -> np.ndarray:
    """One sorted run of the records of one or more: each text once, with the id to retain and the number of rows.

    Sorting is stable, so runs that follow each other in ``records`` are merged, not sorted anew.
    """
    if not len(records):
        return records
    records = records[np.argsort(records["digest"][:, 0], kind="stable")]
    same = np.zeros(len(records), bool)
    same[1:] = (records["digest"][1:] == records["digest"][:-1]).all(axis=1) & (records["check"][1:] == records["check"][:-1])
    close = records["digest"][1:, 0] == records["digest"][:-1, 0]
    if (close & ~same[1:]).any():  # different texts with equal first words: the whole digest decides
        d = records["digest"]
        records = records[np.lexsort((records["check"], d[:, 3], d[:, 2], d[:, 1], d[:, 0]))]
        same[1:] = (records["digest"][1:] == records["digest"][:-1]).all(axis=1) & (records["check"][1:] == records["check"][:-1])
    at = np.flatnonzero(~same)
    out = records[at]
    worst, best = (np.iinfo("i8").min, np.maximum) if keep == "max" else (np.iinfo("i8").max, np.minimum)
    out["id"] = best.reduceat(np.where(records["known"], records["id"], worst), at)
    out["known"] = np.logical_or.reduceat(records["known"], at)
    out["n"] = np.add.reduceat(records["n"], at)
    return out


def exchange(run: np.ndarray, number: int, place: int, rounds: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """The pieces of a sorted run for the runs whose numbers differ in digit ``place`` only; (number, piece)."""
    shift, top = bits * (rounds - 1 - place), bits * rounds
    own = (run["digest"][:, 0] >> np.uint64(64 - top)).astype(np.int64) >> shift  # leading digits of the range
    cuts = np.flatnonzero(np.diff(own, prepend=-1)).tolist() if len(own) else []
    for a, b in zip(cuts, [*cuts[1:], len(run)], strict=True):
        digit = int(own[a]) & ((1 << bits) - 1)
        yield (number & ~(((1 << bits) - 1) << shift)) | digit << shift, run[a:b]


_DDL = "run int, records binary"


def _pieces(run: np.ndarray, number: int, place: int, rounds: int, bits: int) -> Iterator[pa.RecordBatch]:
    if len(run):
        numbers, parts = zip(*exchange(run, number, place, rounds, bits), strict=True)
        yield pa.record_batch([pa.array(numbers, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["run", "records"])


def _runs(keep: str, rounds: int, bits: int):
    """(doc_id, digest, check) batches: the sorted runs of a partition, cut for the first exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() % (1 << bits * rounds), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            records = np.zeros(batch.num_rows, RECORD)
            records["digest"] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4)
            records["check"], records["n"] = batch.column("check").to_numpy(), 1
            records["id"], records["known"] = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            held.append(records)
            size += len(records)
            if size >= RUN:
                yield from _pieces(collapse(np.concatenate(held), keep), number, 0, rounds, bits)
                held, size = [], 0
        if held:
            yield from _pieces(collapse(np.concatenate(held), keep), number, 0, rounds, bits)

    return run


def _merge(keep: str, place: int, rounds: int, bits: int):
    """Rows sorted by run: the pieces that a run received become one sorted run; it is cut for the next exchange, or told if this was the last."""

    def told(number: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        run = collapse(np.concatenate(parts), keep)
        if place + 1 < rounds:
            yield from _pieces(run, number, place + 1, rounds, bits)
            return
        for at in range(0, len(run), 50_000):
            part = run[at : at + 50_000]
            raw = part["digest"].astype(">u8").tobytes()
            digests = pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())
            ids = pa.array(np.ascontiguousarray(part["id"]), mask=~part["known"])
            yield pa.record_batch([digests, pa.array(np.ascontiguousarray(part["check"])), ids, pa.array(np.ascontiguousarray(part["n"]))], names=["digest", "check", "keep_id", "group_size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for number, records in zip(batch.column("run").to_pylist(), batch.column("records").to_pylist(), strict=True):
                if number != at and held:
                    yield from told(at, held)
                    held = []
                at = number
                held.append(np.frombuffer(records, RECORD))
        if held:
            yield from told(at, held)

    return run


def merge_runs(keyed: DataFrame, keep: str = "max", fan_in: int = FAN_IN, rounds: int | None = None) -> DataFrame:
    """keyed(doc_id long, digest, check): one row per text with digest, check, keep_id and group_size.

    ``fan_in`` is a power of two.  Without ``rounds`` there are enough for as many final runs as the session has shuffle partitions.
    """
    bits = fan_in.bit_length() - 1
    if bits < 1 or fan_in != 1 << bits:
        raise ValueError("fan_in is a power of two from 2 on")
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = rounds or max(1, -(-(parts - 1).bit_length() // bits))
    runs = keyed.select("doc_id", "digest", "check").mapInArrow(lean(_runs(keep, rounds, bits)), _DDL)
    for place in range(rounds):
        last = place + 1 == rounds
        runs = runs.repartition("run").sortWithinPartitions("run")
        runs = runs.mapInArrow(lean(_merge(keep, place, rounds, bits)), "digest binary, check long, keep_id long, group_size long" if last else _DDL)
    return runs


def _prints(text_col: str) -> tuple[Column, Column]:
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return F.unhex(F.sha2(norm, 256)), F.xxhash64(norm)


def digest_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = FAN_IN, rounds: int | None = None) -> DataFrame:
    """doc_id, digest, check, keep_id, group_size of every row of docs; each text is read and hashed once."""
    digest, check = _prints(text_col)
    with Scratch(docs.sparkSession) as scratch:
        keyed = scratch.write(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), check.alias("check")), "exact-digests")
        groups = scratch.write(merge_runs(keyed, keep, fan_in, rounds).where("group_size > 1"), "exact-groups")
        found = join_groups(keyed, groups, ["digest", "check"], "group_size")
        alone = F.col("group_size").isNull()
        return scratch.keep(
            found.select("doc_id", "digest", "check", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")), "exact-result"
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = FAN_IN, rounds: int | None = None) -> DataFrame:
    """Marks exact copies.  Adds keep_id, group_size, kept and text_sha256 to every row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null
    and empty texts form one group; very long texts are hashed whole.  Ids are integers.
    Rows of equal id and text count each; all of them are kept if the id is the one
    retained.  A null id loses to any other and is retained only in a group without
    another.  An empty table gives an empty table.  Columns of docs with the names of
    added ones are replaced.
    """
    groups = digest_groups(docs, id_col, text_col, keep, fan_in, rounds).where("group_size > 1").groupBy("digest", "check")
    groups = groups.agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    groups = groups.select(F.col("digest").alias("__digest"), F.col("check").alias("__check"), "keep_id", "group_size")
    kept = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    digest, check = _prints(text_col)
    rows = docs.select(*kept, digest.alias("__digest"), check.alias("__check"))
    rows = join_groups(rows, groups, ["__digest", "__check"], "group_size")
    id_ = F.col(id_col).cast("long")
    keep_id = F.when(F.col("group_size").isNull(), id_).otherwise(F.col("keep_id"))
    return rows.select(*kept, keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), id_.eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, sha256({sql_ascii_lower("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
