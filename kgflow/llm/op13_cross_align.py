"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over a corpus.

Both tokenizers cut the same bytes.  All tokens of A and B are lexsorted by where they start,
``maximum.accumulate`` carries the furthest end, and a group breaks where a start reaches it:
there a token of A and one of B end together.  Within a group every A token is linked with
every B token.

Texts part into words where no token of either can reach across, and a group never spans two
words.  So a block of documents encodes and aligns each of its distinct words once, and tells
Spark how many of its documents hold each pair of ids.  Spark adds these rows up over all
blocks, finds the best partners of each A id and joins the counts back to the blocks.  What
moves is a row for each pair of a block, and for each document its pairs.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.llm.common import Scratch, lean, table
from kgflow.llm.op01_bpe import _BREAK, _Numbers, _starts, _take, load, pieces

#: Characters of text that a block holds, if it does not hold a single longer document.
BLOCK_CHARS = 4_000_000
#: Words that go to a tokenizer at once.
WORDS = 20_000
#: Word occurrences of a block that are looked up at once, if they are not of a single document.
OCCURRENCES = 500_000
#: Pairs that are expanded at once.
PAIRS = 4_000_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class _Side:
    """One tokenizer: ids of words, and the bytes of its ids end to end."""

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each word has."""
        flat, sizes = [], []
        for i in range(0, len(words), WORDS):
            got = self.ids(words[i : i + WORDS])
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.fromiter(itertools.chain.from_iterable(got), np.int64, int(sizes[-1].sum())))
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return _take(self.flat, self.starts[ids], self.lens[ids])


class _ByteLevel(_Side):
    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.tokenizer.encode_special_tokens = True
        self.flat, self.lens = pieces(self.tokenizer)
        self.starts = _starts(self.lens)

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class _Pieces(_Side):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        shown = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        made = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
        self.flat, self.lens = np.frombuffer(b"".join(made), np.uint8), np.fromiter(map(len, made), np.int64, len(made))
        self.starts = _starts(self.lens)
        #: whether no piece holds a space behind another character, so that texts may be cut before spaces
        self.cuts = all("▁" not in p.lstrip("▁") for p in shown)

    def ids(self, words: list[str]) -> list[list[int]]:
        return self.model.encode([w[1:] for w in words], num_threads=1)  # it adds the space in front itself


@functools.lru_cache(2)
def _sides(path_a: str, path_b: str) -> tuple[_ByteLevel, _Pieces]:
    """The tokenizers of two files; a Python worker keeps them for its next task."""
    return _ByteLevel(path_a), _Pieces(path_b)


def coalesce(a_lens: np.ndarray, b_lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token, for tokens that both tile the same bytes in order."""
    start = np.concatenate([_starts(a_lens), _starts(b_lens)])
    end = start + np.concatenate([a_lens, b_lens])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(a_lens)], group[len(a_lens) :]


def _same_bytes(words: list[str], sides: list[tuple[_Side, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which words have tokens whose joined bytes are the word's, on either side."""
    raw = [w.encode() for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    good = lens > 0
    for side, ids, sizes in sides:
        word = np.repeat(np.arange(len(words)), sizes)
        good &= np.bincount(word, side.lens[ids], len(words)).astype(np.int64) == lens
    for side, ids, sizes in sides:
        made = side.bytes_of(ids[np.repeat(good, sizes)])
        wanted = np.frombuffer(b"".join(r for r, g in zip(raw, good.tolist(), strict=True) if g), np.uint8)
        at = np.flatnonzero(good)
        good[at[np.searchsorted(np.cumsum(lens[at]), np.flatnonzero(made != wanted), side="right")]] = False
    return good


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of each group, in the order of groups, and how often each is there."""
    keys, times = np.unique(group << 32 | ids, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, times


class Words:
    """Distinct words, aligned: ``good``, numbers of tokens, groups and links, digest texts, and the links as pairs.

    Pairs are ``pair_a, pair_b`` (ids); word w links pair ``link_pair[i]`` ``link_times[i]`` times for
    ``link_start[w] <= i < link_start[w] + n_pairs[w]``.
    """

    def __init__(self, words: list[str], a: _Side, b: _Side):
        n = len(words)
        a_ids, a_sizes = a.encode(words)
        b_ids, b_sizes = b.encode(words)
        self.good = _same_bytes(words, [(a, a_ids, a_sizes), (b, b_ids, b_sizes)])
        a_ids, b_ids = a_ids[np.repeat(self.good, a_sizes)], b_ids[np.repeat(self.good, b_sizes)]
        self.n_a, self.n_b = np.where(self.good, a_sizes, 0), np.where(self.good, b_sizes, 0)
        a_group, b_group = coalesce(a.lens[a_ids], b.lens[b_ids])
        groups = int(a_group[-1]) + 1 if len(a_group) else 0
        word_of = np.zeros(groups, np.int64)
        word_of[a_group] = np.repeat(np.arange(n), self.n_a)
        self.n_groups = np.bincount(word_of, minlength=n)
        in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, word_of, in_a * in_b)
        self.texts = self._texts(word_of, a_ids, a_group, b_ids, b_group, n)
        self._link(word_of, _counted(a_group, a_ids), _counted(b_group, b_ids), n)

    def _texts(self, word_of, a_ids, a_group, b_ids, b_group, n) -> list[bytes]:
        """a1,a2|b1;a3|b2,b3 for every word."""
        side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        order = np.argsort(np.concatenate([a_group, b_group]) * 2 + side, kind="stable")
        ids, group, side = (np.concatenate(x)[order] for x in ((a_ids, b_ids), (a_group, b_group), (side,)))
        digits = [b",%d" % i for i in range(int(ids.max(initial=0)) + 1)]
        lens = np.fromiter(map(len, digits), np.int64, len(digits))
        text = _take(np.frombuffer(b"".join(digits), np.uint8), _starts(lens)[ids], lens[ids])
        first = _starts(lens[ids])
        new = np.ones(len(ids), bool)
        new[1:] = group[1:] != group[:-1]
        text[first[1:][(side[1:] > side[:-1]) & ~new[1:]]] = ord("|")
        text[first[new]] = ord(";")
        ends = np.cumsum(np.bincount(word_of[group], lens[ids], n).astype(np.int64)) if len(ids) else np.zeros(n, np.int64)
        raw = text.tobytes()
        return [raw[x + 1 : y] for x, y in itertools.pairwise([0, *ends.tolist()])]

    def _link(self, word_of, side_a, side_b, n) -> None:
        (ga, ia, ta), (gb, ib, tb) = side_a, side_b
        fan = np.bincount(gb, minlength=len(word_of))
        first = _starts(fan)
        upto = np.cumsum(fan[ga])
        keys, words, times, at = [], [], [], 0
        while at < len(ga):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            many = fan[ga[at:to]]
            other = np.arange(many.sum()) - np.repeat(_starts(many), many) + np.repeat(first[ga[at:to]], many)
            keys.append(np.repeat(ia[at:to] << 32, many) | ib[other])
            times.append(np.repeat(ta[at:to], many) * tb[other])
            words.append(np.repeat(word_of[ga[at:to]], many))
            at = to
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        pairs, self.link_pair = np.unique(join(keys), return_inverse=True)
        self.pair_a, self.pair_b, self.link_times = pairs >> 32, pairs & 0xFFFFFFFF, join(times)
        self.n_pairs = np.bincount(join(words), minlength=n)
        self.link_start = _starts(self.n_pairs)


_LONGS = ("n_a", "n_b", "n_groups", "n_links")
_SCHEMA = pa.schema(
    [("block", pa.int64()), ("is_doc", pa.bool_()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _LONGS), ("groups_sha256", pa.string())]
    + [("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("pair", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())]
)
_DDL = f"block long, is_doc boolean, doc_id long, {', '.join(c + ' long' for c in _LONGS)}, groups_sha256 string, pairs array<int>, times array<long>, pair int, a int, b int, docs long"


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.record_batch([columns.get(f.name, None) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _list(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, kind))


def _block(block: int, ids: list, codes: list[np.ndarray], words: list[str], sides) -> Iterator[pa.RecordBatch]:
    """Rows of the documents of a block, then those of its pairs."""
    known = Words(words, *sides)
    docs = np.zeros(len(known.pair_a), np.int64)
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    ends, at = np.cumsum(sizes), 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + OCCURRENCES, side="right")))
        part = codes[at:to]
        flat = np.concatenate(part).astype(np.int64)
        doc = np.repeat(np.arange(to - at), sizes[at:to])
        good = np.bincount(doc, ~known.good[flat], to - at) == 0
        digests = [hashlib.sha256(b";".join([known.texts[c] for c in p.tolist()])).hexdigest() if g and len(p) else "" for p, g in zip(part, good.tolist(), strict=True)]
        flat, doc = flat[good[doc]], doc[good[doc]]
        many = known.n_pairs[flat]
        key = np.repeat(doc << 32, many) | _take(known.link_pair, known.link_start[flat], many)
        order = np.argsort(key, kind="stable")
        key, times = key[order], _take(known.link_times, known.link_start[flat], many)[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(key) else times
        pair, per_doc = key[first] & 0xFFFFFFFF, np.bincount(key[first] >> 32, minlength=to - at)
        docs += np.bincount(pair, minlength=len(docs))
        sums = {c: pa.array(np.bincount(doc, getattr(known, c)[flat], to - at).astype(np.int64)) for c in _LONGS}
        yield _rows(to - at, block=pa.array([block] * (to - at), pa.int64()), is_doc=pa.array([True] * (to - at)), doc_id=pa.array(ids[at:to], pa.int64()), **sums, groups_sha256=pa.array(digests, pa.string()), pairs=_list(pair, per_doc, pa.int32()), times=_list(times, per_doc, pa.int64()))
        at = to
    held = np.flatnonzero(docs)  # pairs that only documents without tokens have are held by none
    for k in range(0, len(held), 100_000):
        some = held[k : k + 100_000]
        yield _rows(len(some), block=pa.array(np.full(len(some), block)), is_doc=pa.array(np.zeros(len(some), bool)), pair=pa.array(some, pa.int32()), a=pa.array(known.pair_a[some], pa.int32()), b=pa.array(known.pair_b[some], pa.int32()), docs=pa.array(docs[some]))


def _align(path_a: str, path_b: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(path_a, path_b)
        block = TaskContext.get().partitionId() << 32  # the same when a lost task runs again
        ids, codes, numbers, chars = [], [], _Numbers(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                words = [] if not text else _BREAK.split(" " + text) if sides[1].cuts else [" " + text]
                ids.append(doc_id)
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                chars += len(text)
                if chars > block_chars or len(ids) >= 1 << 20:
                    yield from _block(block, ids, codes, list(numbers), sides)
                    block, ids, codes, numbers, chars = block + 1, [], [], _Numbers(), 0
        if ids:
            yield from _block(block, ids, codes, list(numbers), sides)

    return run


def _count_links(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block with the counts of its pairs."""
    docs, answers = docs.combine_chunks(), answers.combine_chunks()
    pair = answers.column("pair").to_numpy()
    count, best = np.zeros(int(pair.max(initial=-1)) + 2, np.int64), np.zeros(int(pair.max(initial=-1)) + 2, np.int64)
    count[pair], best[pair] = answers.column("count").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False)
    lists, times = (pa.concat_arrays(docs.column(c).chunks) if docs.num_rows else pa.array([], pa.list_(pa.int64())) for c in ("pairs", "times"))
    flat, weight = lists.flatten().to_numpy(), times.flatten().to_numpy()
    ends = np.cumsum(np.array(lists.value_lengths().to_numpy(), np.int64))
    sums = []
    for per_link in (best, count):
        upto = np.concatenate([[0], np.cumsum(per_link[flat] * weight)])
        sums.append(upto[ends] - upto[np.concatenate([[0], ends[:-1]])])
    out = docs.drop_columns(["block", "pairs", "times"])
    return out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))


def align(docs: DataFrame, scratch: Scratch, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """How two tokenizers cut every text: (a row for each document, a row for each pair of ids).

    ``paths`` name a byte-level tokenizer file (A, which gets a space and the text) and a sentencepiece model (B, which
    adds the space itself); neither adds special tokens, and their strings in texts are plain text.
    Documents: doc_id, n_a and n_b (tokens), n_groups, n_links (pairs of occurrences that share a group), groups_sha256
    (of ``a1,a2|b1;a3|b2,b3``, the ids of the groups in order), n_best (links whose pair has the most documents that its
    A id has with any B id, ties included) and count_sum (the documents of the pair, added over the links).
    Pairs: a, b, count (documents that hold them linked) and best.

    A null or empty text, and one whose tokens do not spell it, has no tokens: zeros and an empty digest.  Every row is
    a document of its own, also where ids repeat or are null; an empty table gives empty ones; other columns do not
    matter.  A long text is a block of its own.  The tables that the results read belong to ``scratch``.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    coded = scratch.write(source.mapInArrow(lean(_align(*(paths or default_paths()), block_chars)), _DDL), "align-blocks")
    held = coded.where("NOT is_doc").select("block", "pair", "a", "b", "docs")
    counts = held.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    counts = scratch.write(counts, "align-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    pairs = counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = held.join(pairs, ["a", "b"]).select(F.col("block").alias("of"), "pair", "count", "best")
    rows = coded.where("is_doc").select("block", "doc_id", *_LONGS, "groups_sha256", "pairs", "times")
    out = f"doc_id long, {', '.join(c + ' long' for c in _LONGS)}, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_count_links, out), pairs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), Scratch(spark))[0]
