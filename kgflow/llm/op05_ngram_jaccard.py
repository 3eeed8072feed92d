"""N-gram Jaccard join: all documents whose shingle sets have at least a given Jaccard similarity.

Shingles are ranked by the number of sets that hold them, rare ones first.  Two similar
sets share a shingle among the first few of either, as many as they can differ in and one
more, so the tiles of a size band are the sets that have such a shingle in common; one
that no other set holds needs no tile, nor does a passage that many documents share while
the documents have enough of their own.  Tiles that overlap form a cluster.  In a cluster,
hashed bitmaps come first: the bits in which two of them differ are a lower bound of the
sets' difference, so they bound the overlap from above; exact intersection of the sorted
arrays decides what is left.  No step loses a link.

Equal sets are one node throughout, named by a 64-bit print.  Documents are counted in
chunks: a chunk tells each shingle once, however many of its documents hold it, and gets
back one number for it.  So neither a passage that a third of all documents share nor a
text with very many copies falls to one task; large clusters are dealt into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from kgflow.llm.common import Scratch, connected_components, distinct, join_groups, lean, mix64, sorted_groups, table

BAND_RATIO = 1.6
#: Rows of a cluster that one task compares at once.
BLOCK = 512
#: Blocks whose bitmaps one task compares with as many others.
TILE = 4
#: Bits of the bitmap signatures within a block.
BITS = 2048
#: Shingles of a chunk of documents, if it does not hold a single longer document.
CHUNK = 1 << 20
_REMEMBERED = 1 << 17


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(w))
    acc = np.full(len(w) - width + 1, width, np.uint64)
    for j in range(width):
        acc = mix64((acc + w[j : len(w) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15))
    return distinct(acc)


def set_print(s: np.ndarray) -> int:
    """The node of a set: 64 bits of its elements, as a signed number."""
    return xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def bands_of(sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and the highest size band in which sets of these sizes meet partners that are not larger."""
    tops = [1]
    while len(sizes) and tops[-1] < sizes.max():
        tops.append(int(tops[-1] * BAND_RATIO) + 1)
    return np.searchsorted(tops, -(-sizes * num // den)), np.searchsorted(tops, sizes)


def _pack(a: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


#: Rows of the exchange between chunks and buckets.  Kind 0: a chunk's shingles in a bucket; 1: the bucket's answer to
#: a chunk; 2: the set of a document; 3: a chunk's sets.
_DDL = "kind int, bucket long, chunk long, doc_id long, n long, node long, keys binary, values binary"
_TYPES = {"kind": pa.int32(), "bucket": pa.int64(), "chunk": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "keys": pa.binary(), "values": pa.binary()}


def _rows(size: int, **columns) -> pa.RecordBatch:
    made = [pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in _TYPES.items()]
    return pa.record_batch(made, names=list(_TYPES))


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.empty(len(sorted_keys), bool)
    new[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def _chunks(k: int, buckets: int):
    """(doc_id, text) batches: the set of each document, each chunk's sets, and its shingles by bucket.

    A shingle that one set of the chunk holds is told with the number of the set times
    two, another with twice their number and one.
    """

    def flush(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        nodes, sizes = np.array(list(sets), np.int64), np.fromiter(map(len, sets.values()), np.uint32, len(sets))
        chunk = xxh3_64_intdigest(nodes.tobytes(), TaskContext.get().partitionId()) - (1 << 63)  # the same when a lost task runs again
        keys, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        first = _runs(keys)
        count = np.diff(np.append(first, len(keys))).astype(np.uint32)
        several = count > 1
        told = np.where(several, 2 * count + 1, 2 * owner[first])
        held_keys, holders = keys[first][several], owner[np.repeat(several, count)]
        yield _rows(1, kind=[3], bucket=[chunk % buckets], chunk=[chunk], n=[len(nodes)], keys=[_pack(np.concatenate([nodes.view(np.uint64), held_keys]))], values=[_pack(np.concatenate([sizes, count[several], holders]))])
        keys = keys[first]
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, told, bucket = keys[order], told[order].astype(np.uint32), bucket[order]
        cut = _runs(bucket).tolist()
        parts = list(zip(cut, [*cut[1:], len(keys)], strict=True))
        yield _rows(len(cut), kind=np.zeros(len(cut), np.int32), bucket=bucket[cut], chunk=np.full(len(cut), chunk), keys=[_pack(keys[a:b]) for a, b in parts], values=[_pack(told[a:b]) for a, b in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sets, held = _WordHashes(), {}, 0
        for batch in batches:
            sizes, nodes = [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k, hashes)
                sizes.append(len(s))
                nodes.append(node := set_print(s) if len(s) else None)
                if len(s) and node not in sets:
                    sets[node] = s
                    held += len(s)
                    if held > CHUNK:
                        yield from flush(sets)
                        sets, held = {}, 0
            spread = (np.array([x or 0 for x in nodes], np.int64) ^ np.arange(len(nodes))) % buckets
            yield _rows(len(nodes), kind=np.full(len(nodes), 2, np.int32), bucket=spread, doc_id=batch.column(0).to_pylist(), n=sizes, node=nodes)
        if sets:
            yield from flush(sets)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: answers each chunk with its shingles that other sets hold too, and the number of sets."""
    at, held = None, []

    def answers() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        keys = np.concatenate([x[1] for x in held])
        told = np.concatenate([x[2] for x in held])
        source = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
        order = np.argsort(keys, kind="stable")
        keys, told, source = keys[order], told[order], source[order]
        first = _runs(keys)
        total = np.add.reduceat(np.where(told & 1, told >> 1, 1).astype(np.int64), first)
        total = np.repeat(total, np.diff(np.append(first, len(keys))))
        order = np.flatnonzero(total > 1)
        order = order[np.argsort(source[order], kind="stable")]
        if not len(order):  # no set shares any of the bucket's shingles
            return
        keys, told, source, total = keys[order], told[order], source[order], np.minimum(total[order], 0xFFFFFFFF).astype(np.uint32)
        cut = _runs(source).tolist()
        for a, b in zip(cut, [*cut[1:], len(keys)], strict=True):
            yield _rows(1, kind=[1], chunk=[held[source[a]][0]], keys=[_pack(keys[a:b])], values=[_pack(np.concatenate([told[a:b], total[a:b]]))])

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        rest = batch.filter(pa.array(kind != 0))
        if rest.num_rows:
            yield rest
        batch = batch.filter(pa.array(kind == 0))
        for bucket, chunk, keys, told in zip(batch.column("bucket").to_pylist(), batch.column("chunk").to_pylist(), batch.column("keys"), batch.column("values"), strict=True):
            if bucket != at:
                yield from answers()
                at, held = bucket, []
            held.append((chunk, _unpack(keys.as_py(), "<u8"), _unpack(told.as_py(), "<u4")))
    yield from answers()


def prefix_tiles(sizes: np.ndarray, owner: np.ndarray, keys: np.ndarray, total: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, sets) of the tiles of sets of these sizes.

    (owner, keys, total) are the shingles that several sets hold: the rest are rarer and
    come first.  A set of n shingles looks at its n - ceil(n * num / den) + 1 rarest.
    """
    sizes = sizes.astype(np.int64)
    take = np.bincount(owner, minlength=len(sizes)) + 1 - -(-sizes * num // den)
    order = np.lexsort((keys, total, owner))
    owner, keys = owner[order], keys[order]
    first = _runs(owner)
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    owner, keys = owner[chosen := rank < take[owner]], keys[chosen]
    low, high = bands_of(sizes, num, den)
    times = (high - low + 1)[owner]
    band = np.repeat(low[owner], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return mix64(np.repeat(keys, times) + mix64(band.astype(np.uint64))), np.repeat(owner, times)


def _star(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each signature once with its smallest node; and links of the other nodes to that one."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = _runs(sig)
    head = np.repeat(node[first], np.diff(np.append(first, len(sig))))
    return sig[first], node[first], np.unique(np.stack([node, head])[:, node != head], axis=1)


_TILE_DDL = "bucket long, a long, b long, keys binary, nodes binary"


def _tile_rows(bucket, a=None, b=None, keys=None, nodes=None) -> pa.RecordBatch:
    cols = [(bucket, pa.int64()), (a, pa.int64()), (b, pa.int64()), (keys, pa.binary()), (nodes, pa.binary())]
    return pa.record_batch([pa.nulls(len(bucket), t) if c is None else pa.array(c, t) for c, t in cols], names=["bucket", "a", "b", "keys", "nodes"])


def _tiles(num: int, den: int, buckets: int):
    """Rows sorted by chunk, its sets and the answers to it: links within the task and tiles by bucket."""

    def chunk_tiles(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray] | None:
        sets = next((r for r in rows if r[0] == 3), None)
        answers = [(_unpack(r[2], "<u8"), _unpack(r[3], "<u4").reshape(2, -1)) for r in rows if r[0] == 1]
        if sets is None or not answers:
            return None
        n, known, numbers = sets[1], _unpack(sets[2], "<u8"), _unpack(sets[3], "<u4").astype(np.int64)
        nodes, held = known[:n].view(np.int64), known[n:]
        sizes, count, holders = numbers[:n], numbers[n : n + len(held)], numbers[n + len(held) :]
        keys, told, total = np.concatenate([a[0] for a in answers]), *np.concatenate([a[1] for a in answers], axis=1).astype(np.int64)
        one = told & 1 == 0
        at = np.searchsorted(held, keys[~one])
        times, start = count[at], (np.cumsum(count) - count)[at]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        owner = np.concatenate([told[one] >> 1, holders[np.repeat(start, times) + within]])
        sig, of = prefix_tiles(sizes, owner, np.concatenate([keys[one], np.repeat(keys[~one], times)]), np.concatenate([total[one], np.repeat(total[~one], times)]), num, den)
        return sig, nodes[of]

    def flush(made: list[tuple]) -> Iterator[pa.RecordBatch]:
        sig, node, links = _star(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]))
        if links.size:
            yield _tile_rows(links[0] % buckets, a=links[0], b=links[1])
        if not len(sig):  # no set has a shared shingle among its rarest
            return
        bucket = (sig % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sig, node, bucket = sig[order], node[order], bucket[order]
        cut = _runs(bucket).tolist()
        parts = list(zip(cut, [*cut[1:], len(sig)], strict=True))
        yield _tile_rows(bucket[cut], keys=[_pack(sig[a:b]) for a, b in parts], nodes=[_pack(node[a:b]) for a, b in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, made, size = None, [], [], 0
        for batch in batches:
            for chunk, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "n", "keys", "values")), strict=True):
                if chunk != at:
                    if got := chunk_tiles(rows):
                        made.append(got)
                        size += len(got[0])
                    at, rows = chunk, []
                    if size > CHUNK:
                        yield from flush(made)
                        made, size = [], 0
                rows.append(tuple(row))
        if got := chunk_tiles(rows):
            made.append(got)
        if made:
            yield from flush(made)

    return run


def _merge_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns the tiles of whole buckets into links; passes the links on."""
    sigs, nodes = [], []
    for batch in batches:
        tiles = batch.filter(batch.column("keys").is_valid())
        sigs += [_unpack(x, "<u8") for x in tiles.column("keys").to_pylist()]
        nodes += [_unpack(x, "<i8") for x in tiles.column("nodes").to_pylist()]
        links = batch.filter(batch.column("keys").is_null())
        if links.num_rows:
            yield links.select(["a", "b"])
    if sigs:
        links = _star(np.concatenate(sigs), np.concatenate(nodes))[2]
        if links.size:
            yield pa.record_batch([pa.array(links[0]), pa.array(links[1])], names=["a", "b"])


def _features(k: int):
    """(node, cluster, text): the shingles of the texts whose set the node is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t.as_py(), k, hashes) for t in part.column("text")]
                part = part.append_column("shingles", pa.array([x.tobytes() for x in sets], pa.binary()))
                right = [set_print(x) == n for x, n in zip(sets, part.column("node").to_pylist(), strict=True)]  # a repeated id may have other texts
                yield part.filter(pa.array(right, pa.bool_())).select(["cluster", "node", "shingles"])

    return run




def bitmap(s: np.ndarray, width: int = BITS) -> np.ndarray:
    bits = np.zeros(width, np.uint8)
    bits[(s % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def linked(i: int, others: np.ndarray, sets: list, sizes: np.ndarray, maps: np.ndarray, num: int, den: int) -> list[int]:
    """Those of ``others`` whose sets have at least num / den similarity to set i."""
    near = others[(sizes[others] * den >= sizes[i] * num) & (sizes[i] * den >= sizes[others] * num)]
    both = sizes[near] + sizes[i]
    differ = np.bitwise_count(maps[near] ^ maps[i]).sum(axis=1, dtype=np.int64)
    near = near[(both - differ) * (den + num) >= 2 * num * both]  # overlap <= (both - differ) / 2
    out = []
    for j in near.tolist():
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if common * den >= num * (int(sizes[i] + sizes[j]) - common):
            out.append(j)
    return out


def _arrays(shingles: list[bytes]) -> tuple[list, np.ndarray, np.ndarray]:
    sets = [np.frombuffer(x, np.uint64) for x in shingles]
    return sets, np.fromiter(map(len, sets), np.int64, len(sets)), np.stack([bitmap(s) for s in sets])


def spanning_links(shingles: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Links that span the components of a block.  Each search compares with rows not reached yet only."""
    sets, sizes, maps = _arrays(shingles)
    todo, links = np.arange(len(sets)), []
    while len(todo):
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            i = queue.pop()
            found = linked(i, todo, sets, sizes, maps, num, den)
            links += [(i, j) for j in found]
            queue += found
            todo = todo[~np.isin(todo, found)]
    return links


def _compare_blocks(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, ["cluster", "block"]):
            ids = g["node"].to_numpy()
            links = spanning_links(g["shingles"].tolist(), num, den)
            yield pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes and bitmaps of sets; a bitmap has four bits or more for each element, so that its bound stays sharp."""
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
        maps = [bitmap(s, max(1024, 1 << (4 * len(s) - 1).bit_length())).tobytes() for s in sets]
        yield pa.record_batch([batch.column("cluster"), batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(maps, pa.binary())], names=["cluster", "node", "n", "bits"])


def _by_width(g: pd.DataFrame) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(words, (ids, sizes, components, bitmaps)) of rows with bitmaps of one width, by size."""
    for width, rows in g.sort_values("n").groupby(g["bits"].map(len)):
        maps = np.stack([np.frombuffer(x, np.uint64) for x in rows["bits"]])
        yield width // 8, (rows["node"].to_numpy(), rows["n"].to_numpy(), rows["component"].to_numpy(), maps)


def _possible_pairs(num: int, den: int):
    """Tiles of a large cluster, block i against block j: pairs of different components that the bitmaps allow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, ["cluster", "i", "j"]):
            i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
            a, b = [], []
            for wl, left in _by_width(g[g["own"] == i]):
                for wr, (ids, sizes, component, maps) in _by_width(g[g["own"] == j]):
                    w = min(wl, wr)
                    maps = np.bitwise_or.reduce(maps.reshape(len(maps), -1, w), axis=1)
                    for doc, n, c, m in zip(*left, strict=True):
                        lo, hi = np.searchsorted(sizes, -(-n * num // den), "left"), np.searchsorted(sizes, n * den // num, "right")
                        both = sizes[lo:hi] + n
                        differ = np.bitwise_count(maps[lo:hi] ^ np.bitwise_or.reduce(m.reshape(-1, w), axis=0)).sum(axis=1, dtype=np.int64)
                        ok = ((both - differ) * (den + num) >= 2 * num * both) & (component[lo:hi] != c) & ((i != j) | (ids[lo:hi] > doc))
                        found = ids[lo:hi][ok]
                        a.append(np.full(len(found), doc))
                        b.append(found)
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}, dtype="int64")

    return run


def _exact(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(common * den >= num * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _in_blocks(ids: DataFrame, seed: int, block: int) -> DataFrame:
    """ids(cluster, node): adds blocks and block; clusters of more than ``block`` nodes are dealt into blocks of about that many."""
    n = ids.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return ids.join(n, "cluster").withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).cast("int"))


def _links_in_blocks(dealt: DataFrame, features: DataFrame, num: int, den: int) -> DataFrame:
    """Only ids meet by cluster; the sets meet their blocks by id, so a large cluster's sets are never in one task."""
    rows = features.select("node", "shingles").join(dealt, "node").repartition("cluster", "block").sortWithinPartitions("cluster", "block")
    return rows.select("cluster", "block", "node", "shingles").mapInPandas(lean(_compare_blocks(num, den)), "a long, b long")


def verified_links(features: DataFrame, num: int, den: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """features(cluster, node, shingles): links (a, b) that span the components of each cluster.

    A cluster of one block is compared whole.  A larger one is compared block by block,
    then the smallest nodes of its components in blocks of their own as long as that
    halves their number.  Then the bitmaps of the whole cluster meet tile by tile, and
    the pairs of different components that they allow are checked exactly, so that no
    link between components is missed.
    """
    dealt = scratch.write(_in_blocks(features.select("cluster", "node"), 0, block), "ngram-blocks")
    links = scratch.write(_links_in_blocks(dealt, features, num, den), "ngram-links")
    ids = scratch.write(dealt.where("blocks > 1").select("cluster", "node"), "ngram-large")
    if ids.isEmpty():
        return links

    def components(of: DataFrame) -> DataFrame:
        found = connected_components(of, scratch=scratch)
        named = ids.join(found, "node", "left").select("cluster", "node", F.coalesce("component", "node").alias("component"))
        return scratch.write(named, "ngram-components")

    known, seed, before = components(links), 1, None
    while True:
        heads = known.where("node = component").select("cluster", "node")
        many = heads.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
        heads = scratch.write(heads.join(many, "cluster"), "ngram-heads")
        left = heads.count()
        if before is not None and 2 * left > before:
            break
        before = left
        more = scratch.write(_links_in_blocks(_in_blocks(heads, seed, block), features, num, den), "ngram-links")
        if more.isEmpty():
            break
        links, seed = links.union(more), seed + 1
        known = components(links)
    if not left:
        return links
    parts = known.groupBy("cluster").agg(F.count_distinct("component").alias("parts"), F.ceil(F.count("*") / (TILE * block)).cast("int").alias("tiles"))
    open_ids = scratch.write(known.join(parts.where("parts > 1"), "cluster").select("node", "component", "tiles"), "ngram-ids")
    maps = features.join(open_ids, "node").select("cluster", "node", "shingles").mapInArrow(lean(_bitmaps), "cluster long, node long, n long, bits binary")
    maps = maps.join(open_ids, "node").withColumn("own", F.pmod(F.xxhash64("node", F.lit(0)), "tiles").cast("int"))
    maps = maps.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    maps = maps.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n", "bits")
    met = maps.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    pairs = scratch.write(met.mapInPandas(lean(_possible_pairs(num, den)), "a long, b long"), "ngram-pairs")
    sets = features.select("node", "shingles")
    checked = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    last = scratch.write(checked.select("a", "b", "sa", "sb").mapInArrow(lean(_exact(num, den)), "a long, b long"), "ngram-links")
    return links.union(last)


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Two documents link when den * |A and B| >= num * |A or B| for their sets of k-word
    shingles; component_id is the smallest id reachable by links.  A null or empty text,
    or one without words, has no shingles and links with nothing; one with fewer than k
    words is one shingle; very long texts are taken whole.  Ids are integers.  A row whose
    id is null lends no id to others and gets their component.  Rows that repeat an id
    come out once each, each with the component of its own text.  An empty table gives an
    empty table; other columns of docs do not matter.
    """
    if not 0 < num <= den:
        raise ValueError("a similarity is above 0 and at most 1")
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(spark) as scratch:
        made = source.mapInArrow(lean(_chunks(k, buckets)), _DDL).repartition("bucket").sortWithinPartitions("bucket")
        made = scratch.write(made.mapInArrow(lean(_frequencies), _DDL), "ngram-chunks")
        sets = made.where("kind = 2").select("doc_id", F.col("n").alias("n_shingles"), "node")
        tiles = made.where("kind IN (1, 3)").select("chunk", "kind", "n", "keys", "values").repartition("chunk").sortWithinPartitions("chunk")
        tiles = tiles.mapInArrow(lean(_tiles(num, den, buckets)), _TILE_DDL).repartition("bucket").mapInArrow(lean(_merge_tiles), "a long, b long")
        tiles = scratch.write(tiles.distinct(), "ngram-tiles")
        clusters = connected_components(tiles, scratch=scratch).withColumnRenamed("component", "cluster")
        classes = scratch.write(sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "ngram-classes")
        wanted = scratch.write(classes.where("rep IS NOT NULL").join(clusters, "node").select("rep", "node", "cluster"), "ngram-wanted")
        members = source.hint("merge").join(wanted, F.col("doc_id") == F.col("rep"))  # the clusters grow with the corpus and are not broadcast
        features = members.select("cluster", "node", "text").mapInArrow(lean(_features(k)), "cluster long, node long, shingles binary").dropDuplicates(["node"])
        features = scratch.write(features, "ngram-features")
        found = connected_components(verified_links(features, num, den, scratch), scratch=scratch)
        named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        groups = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1")
        answers = scratch.write(named.join(groups, "component").select("node", "n", "component_id"), "ngram-answers")
        return scratch.keep(
            join_groups(sets, answers, ["node"], "n").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "ngram-result"
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
