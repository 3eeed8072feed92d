"""BPE encoding and decoding through a table of distinct words.

Texts are split into words where no token can reach across.  Blocks of documents keep
their words as positions in a list of the block's distinct words; the lists meet by
word, so that each distinct word is encoded once, and come back to their blocks as
token ids.  A document's ids are then those of its words by position.  Decoding is a join
of the ids with the vocabulary, a table of id and piece whose size the tokenizer's file
fixes: each worker holds it as arrays and looks the ids up.

What moves between tasks are the blocks' word lists, their ids and the positions, all
packed; no row is shuffled for a single word occurrence.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from kgflow.llm.common import Scratch, lean, scratch_path, table

#: Characters of text that a block holds, if it does not hold a single longer document.
BLOCK_CHARS = 12_000_000
#: Distinct words that a task remembers while it encodes.
CACHE = 1_000_000
#: Bytes of decoded text that a batch of results holds.
OUT_BYTES = 4_000_000
#: Between a character that is no white space and a space that a further such character follows.
_BREAK = re.compile(r"(?<=\S)(?= \S)")
_RUN = re.compile(r"\s\s|\0")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def split_words(text: str) -> list[str]:
    """Parts of a text that byte-level BPE encodes independently; joined they are the text.

    A token starts at a space that a visible character follows, and white space that a
    line break makes up alone is a token of its own.  Texts with longer runs of white
    space, in which a token may hold several, are cut at single spaces only.
    """
    if _RUN.search(text):
        return _BREAK.split(text)
    words = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return [w for w in words if w] if not words[0] or not words[-1] else words


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _pack(a: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte of their width, compressed."""
    a = np.ascontiguousarray(a, "<u4")
    return zstandard.compress(a.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("homes", pa.binary()), ("codes", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("nulls", pa.binary())])
_DDL = "block long, bucket int, words binary, homes binary, codes binary, ids binary, sizes binary, nulls binary"


_TAGGED = _SCHEMA.append(pa.field("tags", pa.binary()))
_TAGGED_DDL = _DDL + ", tags binary"


def _split(buckets: int, tagged: bool = False):
    """(doc_id, text) batches, with a third column of strings if ``tagged``: blocks, whose documents keep that column."""
    schema = _TAGGED if tagged else _SCHEMA

    def pack(ids: list, codes: list[np.ndarray], numbers: _Numbers, tags: list) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(numbers)
        words = [words[i] for i in order.tolist()]
        home = np.fromiter((xxh3_64_intdigest(w) % buckets for w in words), np.uint32, len(words))
        block = int.from_bytes(os.urandom(7), "little")
        by_home = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[by_home], np.arange(buckets + 1))
        rows: dict[str, list] = {f.name: [] for f in schema}

        def add(**row):
            for name, col in rows.items():
                col.append(row.get(name))

        for k in np.flatnonzero(np.diff(cuts)).tolist():
            listed = "\0".join(words[i] for i in by_home[cuts[k] : cuts[k + 1]].tolist()) if not any("\0" in words[i] for i in by_home[cuts[k] : cuts[k + 1]].tolist()) else None
            if listed is None:  # a word with the separator in it: lengths go before the words
                part = [words[i].encode() for i in by_home[cuts[k] : cuts[k + 1]].tolist()]
                blob = b"\1" + len(part).to_bytes(4, "little") + np.array([len(p) for p in part], "<u4").tobytes() + b"".join(part)
            else:
                blob = b"\0" + listed.encode()
            add(block=block, bucket=k, words=zstandard.compress(blob, 9))
        none = np.array([x is None for x in ids], np.uint8)
        add(block=block, bucket=buckets, homes=_pack(home), codes=_pack(rank[flat]), ids=np.array([x or 0 for x in ids], "<i8").tobytes(), sizes=_pack(sizes), nulls=none.tobytes(), tags=zstandard.compress(json.dumps(tags).encode(), 1))
        return pa.record_batch([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, numbers, chars, tags = [], [], _Numbers(), 0, []
        for batch in batches:
            if tagged:
                waiting = batch.column(2).to_pylist()
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                text = text.as_py() or ""
                words = split_words(text) if text else []
                ids.append(doc_id)
                if tagged:
                    tags.append(waiting[i])
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                chars += len(text)
                if chars > BLOCK_CHARS or len(ids) >= 1 << 20:
                    yield pack(ids, codes, numbers, tags)
                    ids, codes, numbers, chars, tags = [], [], _Numbers(), 0, []
        if ids:
            yield pack(ids, codes, numbers, tags)

    return run


def _listed(blob: bytes) -> list[str]:
    blob = zstandard.decompress(blob)
    if blob[0] == 0:
        return blob[1:].decode().split("\0")
    n = int.from_bytes(blob[1:5], "little")
    ends = np.cumsum(np.frombuffer(blob, "<u4", n, 5)).tolist()
    body = blob[5 + 4 * n :]
    return [body[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _encode(path: str):
    """Word lists of whole buckets: each distinct word is encoded once and answers every block that lists it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = load(path), {}
        for batch in batches:
            for i in range(batch.num_rows):
                words = _listed(batch.column("words")[i].as_py())
                if len(known) > CACHE:
                    known.clear()
                new = [w for w in words if w not in known]
                for w, e in zip(new, tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, np.uint32)
                got = [known[w] for w in words]
                counts = np.fromiter(map(len, got), np.uint32, len(got))
                yield pa.record_batch([batch.column("block").slice(i, 1), batch.column("bucket").slice(i, 1), pa.array([_pack(counts)], pa.binary()), pa.array([_pack(np.concatenate(got))], pa.binary())], names=["block", "bucket", "counts", "tokens"])

    return run


def _take(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + counts[i]] for all i, end to end."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - counts), counts)]


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def pieces(tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces end to end, and the length of each: the decoder's table of id to piece."""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]  # bytes that byte-level BPE writes as themselves
    hidden = [c for c in range(256) if c not in set(shown)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        table[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return np.frombuffer(b"".join(table), np.uint8), np.fromiter(map(len, table), np.int64, len(table))


def _join_back(path: str):
    """Blocks with the ids of their words: ids and decoded text of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_bytes, piece_lens = pieces(load(path))
        piece_starts = _starts(piece_lens)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                answers = {a["bucket"]: (_unpack(a["counts"]), _unpack(a["tokens"])) for a in row["answers"] or []}
                home, codes, sizes = _unpack(row["homes"]), _unpack(row["codes"]), _unpack(row["sizes"]).astype(np.int64)
                ids, null = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], np.uint8).astype(bool)
                by_home = np.argsort(home, kind="stable")
                count, start = np.zeros(len(home), np.int64), np.zeros(len(home), np.int64)
                present = sorted(answers)
                if present:
                    count[by_home] = np.concatenate([answers[k][0] for k in present])
                    start[by_home] = _starts(count[by_home])
                flat = np.concatenate([answers[k][1] for k in present]) if present else np.zeros(0, np.uint32)
                ends = np.cumsum(sizes)
                a = 0
                while a < len(ids):  # some documents at a time
                    b, lo = a, int(ends[a] - sizes[a])
                    b = max(a + 1, int(np.searchsorted(ends, lo + OUT_BYTES // 8, side="right")))
                    c = codes[lo : int(ends[b - 1])]
                    tokens = _take(flat, start[c], count[c]).astype(np.int64)
                    text = _take(piece_bytes, piece_starts[tokens], piece_lens[tokens])
                    token_ends = np.concatenate([[0], np.cumsum(count[c])])[np.concatenate([[0], ends[a:b] - lo])]
                    byte_ends = np.concatenate([[0], np.cumsum(piece_lens[tokens])])[token_ends]
                    raw = text.tobytes()
                    decoded = [raw[x:y].decode("utf-8", "replace") for x, y in zip(byte_ends[:-1].tolist(), byte_ends[1:].tolist(), strict=True)]
                    lists = pa.ListArray.from_arrays(pa.array(token_ends.astype(np.int32)), pa.array(tokens.astype(np.int32)))
                    yield pa.record_batch([pa.array(ids[a:b], mask=null[a:b]), lists, pa.array(decoded, pa.string())], schema=schema)
                    a = b

    return run


def _blocks(source: DataFrame, buckets: int, scratch: Scratch | None, tagged: bool = False) -> DataFrame:
    """The blocks of source(doc_id, text) as a table that is laid out by block."""
    spark, name = source.sparkSession, f"bpe_blocks_{uuid.uuid4().hex}"
    blocks = source.mapInArrow(lean(_split(buckets, tagged)), _TAGGED_DDL if tagged else _DDL)
    where = scratch_path(spark, "bpe-blocks")
    if scratch:
        scratch.own(where, name)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(parts, "block").option("path", where).saveAsTable(name)
    return spark.table(name)


def bpe_round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, ids (token ids of the whole text) and decoded (the text of those ids) for every row of docs.

    Ids are those of the tokenizers library for the file at ``path``, of the byte-level
    kind, without added special tokens.  A null or empty text has no ids and decodes
    to the empty text.  Rows that repeat an id come out once each, a null id stays null,
    an empty table gives an empty one, and other columns of docs do not matter.  Very long
    texts are a block of their own.

    The blocks are a bucketed table that the result reads; it goes with ``scratch`` if one
    is given, for callers that write the result within that scope.
    """
    spark, path = docs.sparkSession, path or default_path()
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = _blocks(source, buckets, scratch)
    lists = made.where(F.col("bucket") < buckets).select("block", "bucket", "words")
    encoded = lists.repartition("bucket").mapInArrow(lean(_encode(path)), "block long, bucket int, counts binary, tokens binary")
    answers = encoded.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts", "tokens")).alias("answers"))
    held = made.where(F.col("bucket") == buckets).select("block", "homes", "codes", "ids", "sizes", "nulls")
    # the table is laid out by block, so the positions stay where they are and only the answers move
    return held.hint("merge").join(answers, "block", "left").mapInArrow(lean(_join_back(path)), "doc_id long, ids array<int>, decoded string")


def _lengths(paths: list[str]):
    """Word lists of whole buckets: the numbers of tokens of each distinct word under each tokenizer, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, known = [load(p) for p in paths], {}
        for batch in batches:
            for i in range(batch.num_rows):
                words = _listed(batch.column("words")[i].as_py())
                if len(known) > CACHE:
                    known.clear()
                new = [w for w in words if w not in known]
                for w, *encoded in zip(new, *(t.encode_batch(new, add_special_tokens=False) for t in tokenizers), strict=True):
                    known[w] = [len(e.ids) for e in encoded]
                counts = np.array([known[w] for w in words], np.uint32).T.ravel()
                yield pa.record_batch([batch.column("block").slice(i, 1), batch.column("bucket").slice(i, 1), pa.array([_pack(counts)], pa.binary())], names=["block", "bucket", "counts"])

    return run


def _sum_back(n: int):
    """Blocks with the lengths of their words: the number of tokens of every document under each of n tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                answers = {a["bucket"]: _unpack(a["counts"]).reshape(n, -1) for a in row["answers"] or []}
                home, codes, sizes = _unpack(row["homes"]), _unpack(row["codes"]), _unpack(row["sizes"]).astype(np.int64)
                counts = np.zeros((n, len(home)), np.int64)
                if answers:
                    counts[:, np.argsort(home, kind="stable")] = np.concatenate([answers[k] for k in sorted(answers)], axis=1)
                ends, null = np.cumsum(sizes), np.frombuffer(row["nulls"], np.uint8).astype(bool)
                sums = []
                for c in counts:
                    upto = np.concatenate([[0], np.cumsum(c[codes])])
                    sums.append(upto[ends] - upto[ends - sizes])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * n), pa.array(np.stack(sums, axis=1).ravel()))
                tags = json.loads(zstandard.decompress(row["tags"]))
                yield pa.record_batch([pa.array(np.frombuffer(row["ids"], "<i8"), mask=null), pa.array(tags, pa.string()), lists], names=["doc_id", "tag", "counts"])

    return run


def token_counts(docs: DataFrame, paths: list[str], scratch: Scratch) -> DataFrame:
    """docs(doc_id, text, tag): doc_id, tag and the array of token counts under the tokenizer of each path.

    Each distinct word is encoded once for all documents.  Words part at white space, which
    no token of these tokenizers spans except as a run that ``split_words`` keeps whole.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("tag").cast("string").alias("tag"))
    made = _blocks(source, buckets, scratch, True)
    lists = made.where(F.col("bucket") < buckets).select("block", "bucket", "words").repartition("bucket")
    lengths = lists.mapInArrow(lean(_lengths(paths)), "block long, bucket int, counts binary")
    answers = lengths.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    held = made.where(F.col("bucket") == buckets).select("block", "homes", "codes", "ids", "sizes", "nulls", "tags")
    return held.hint("merge").join(answers, "block", "left").mapInArrow(lean(_sum_back(len(paths))), "doc_id long, tag string, counts array<long>")


def digests(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe_round_trip(table(spark, sf_dir, "documents")))
