"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from kgflow.llm import op11_orchard as op11
from kgflow.llm import op12_secret_novelty as op12
from kgflow.llm import op13_cross_align as op13
from kgflow.llm.common import Scratch


def _tokens(texts):
    """(A ids, A bytes, B ids, B bytes) of every text, by the libraries."""
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    a.no_truncation()
    b = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for t in texts:
        a_ids, b_ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        a_bytes = [bytes(byte[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        yield a_ids, a_bytes, b_ids, b_bytes


def plain_align(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; by the definition, token by token."""
    links, rows = [], []
    for t, (a_ids, a_bytes, b_ids, b_bytes) in zip(texts, _tokens([t or "" for t in texts]), strict=True):
        if not t or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            links.append(Counter())
            rows.append((0, 0, 0, 0, ""))
            continue
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (a_bytes, b_bytes)]
        cuts = sorted(ends[0] & ends[1])
        groups = defaultdict(lambda: ([], []))
        for k, (ids, raw) in enumerate(((a_ids, a_bytes), (b_ids, b_bytes))):
            at = 0
            for i, x in zip(ids, raw, strict=True):
                at += len(x)
                groups[next(c for c in cuts if c >= at)][k].append(i)
        found = Counter((x, y) for g in groups.values() for x in g[0] for y in g[1])
        said = ";".join(",".join(map(str, groups[c][0])) + "|" + ",".join(map(str, groups[c][1])) for c in cuts)
        links.append(found)
        rows.append((len(a_ids), len(b_ids), len(cuts), found.total(), hashlib.sha256(said.encode()).hexdigest()))
    count = Counter(p for f in links for p in f)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(*r[:4], sum(n for p, n in f.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in f.items()), r[4]) for r, f in zip(rows, links, strict=True)]


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _odd_texts():
    rnd = random.Random(5)
    parts = [*"abcé ñß,.!?\n\t12'<>|日本語😀 \0", "  ", "<s>", "<0x41>", "<|endoftext|>", "the", "token", " of", " ", "▁"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(300)] + [None, "", " ", "▁", "日本語" * 400, "x" * 5000, "!" * 3000, "\r\n" * 50, "same text", "same text", "<|endoftext|>"]


@pytest.mark.parametrize("chars", [100, op13.BLOCK_CHARS])
def test_alignment(spark, chars):
    texts = _odd_texts()
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "block": 1, "pairs": "x", "n_a": 2}), "doc_id long, text string, block int, pairs string, n_a int").repartition(5)
    with Scratch(spark) as scratch:
        rows, pairs = op13.align(docs, scratch, block_chars=chars)
        got = {r.doc_id: tuple(r[c] for c in _COLUMNS) for r in rows.collect()}
        best = pairs.where("best").count()
        assert 0 < best <= pairs.count()
    want = plain_align(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[6] == "" for w in want) > 5 and max(w[3] for w in want) > 1000


def test_alignment_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r[c] for c in _COLUMNS) for r in op13.query(spark, sf).collect()}
    assert [got[d.doc_id] for d in docs] == plain_align([d.text for d in docs])


def test_alignment_in_small_steps():
    """The same words whatever is encoded, expanded or looked up at once."""
    words = [" " + t for t in _odd_texts() if t]
    sides = op13._sides(*op13.default_paths())
    whole = op13.Words(words, *sides)
    op13.WORDS, op13.PAIRS, before = 7, 50, (op13.WORDS, op13.PAIRS)
    try:
        parts = op13.Words(words, *sides)
    finally:
        op13.WORDS, op13.PAIRS = before
    for k, v in vars(whole).items():
        assert np.array_equal(v, getattr(parts, k)) if isinstance(v, np.ndarray) else v == getattr(parts, k)


def test_groups_break_where_both_end():
    a, b = op13.coalesce(np.array([1, 2, 3, 1]), np.array([3, 1, 1, 1, 1]))
    assert a.tolist() == [0, 0, 1, 2] and b.tolist() == [0, 1, 1, 1, 2]


def test_alignment_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    with Scratch(spark) as scratch:
        assert op13.align(spark.createDataFrame([], schema), scratch)[0].count() == 0
        got = op13.align(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], schema), scratch)[0].collect()
    assert sorted(((r.doc_id, r.n_links, r.count_sum) for r in got), key=str) == [(1, 2, 6), (1, 2, 6), (2, 0, 0), (None, 2, 6)]


def plain_clusters(rows, k, rounds, dims, salt=2):
    """(vec_id, cluster, distance) and the centroids; by the definition, vector by vector."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), p) for i, p in kept if i is not None)
    centroids = [p for _, p in order[:k]]

    def near(p):
        return min((sum((x - y) ** 2 for x, y in zip(p, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, p in kept:
            members[near(p)[1]].append(p)
        for i, ps in members.items():
            centroids[i] = [sum(x) // len(ps) for x in zip(*ps, strict=True)]
    return sorted([(i, near(p)[1], near(p)[0]) for i, p in kept], key=str), centroids


def _vectors(n, dims, seed=3):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([rnd.gauss(0, 1), 0.25 * rnd.randint(-2, 2)]) for _ in range(dims)]) for i in range(n)]
    return rows + [(7, rows[3][1]), (7, rows[4][1]), (None, rows[2][1]), (n, None), (n + 1, []), (n + 2, [1.0] * (dims - 1) + [None]), (n + 3, [math.inf] + [0.0] * (dims - 1)), (n + 4, [math.nan] * dims), (n + 5, [1.0] * (dims + 1)), (n + 6, [0.0] * dims), (n + 7, [-0.0] * dims)]


@pytest.mark.parametrize(("n", "k", "dims"), [(400, 12, 3), (60, 40, 64), (5, 40, 2), (0, 3, 2)])
def test_clusters(spark, n, k, dims):
    rows = _vectors(n, dims) if n else [(1, None)]
    df = spark.createDataFrame([(*r, 9, [1]) for r in rows], "vec_id long, embedding array<double>, cluster int, point array<int>").repartition(3)
    with Scratch(spark) as scratch:
        got, centroids = op11.cluster(df, scratch, k=k, dims=dims)
        got = sorted([tuple(r) for r in got.collect()], key=str)
    want, means = plain_clusters(rows, k, 5, dims)
    assert got == want and centroids.tolist() == means


def test_clusters_of_huge_components(spark):
    df = spark.createDataFrame([(1, [1e300, -1e300]), (2, [1e300, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with Scratch(spark) as scratch:
        got, _ = op11.cluster(df, scratch, k=2, dims=2)
        assert {r.vec_id for r in got.where("distance >= 0").collect()} == {1, 2, 3}


def test_orchard_is_exact_and_prunes():
    rng = np.random.default_rng(0)
    for spread in (3, 1000):
        p, c = rng.integers(-spread, spread, (2000, 3)), rng.integers(-spread, spread, (40, 3))
        at, d, taken = op11.nearest(p, c)
        every = ((p[:, None] - c[None]) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (d == every.min(1)).all() and taken < every.size / 2


def plain_base(text):
    """(start, kind, end) by the patterns as they are given."""
    t = text or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, t, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def _told(spans):
    return ",".join(f"{op12.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _same_base(docs, got):
    for (_, text), r in zip(docs, got, strict=True):
        base = plain_base(text)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b[1] == k for b in base) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(_told(base).encode()).hexdigest()
        assert sorted(set(_told(base).split(",")) - {""}) == sorted({s for s in r.spans.split(",") if s and not s.startswith("novel")})


def test_secrets_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = op12.query(spark, sf).orderBy("doc_id").collect()
    _same_base(docs, got)
    assert sum(r.n_assign for r in got) > 0 and not any("novel" in r.spans for r in got)


def test_base_spans_of_random_texts():
    rnd = random.Random(4)
    parts = ["token", "TOKEN", "secret", "api_key", "apikey", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABCDEF123456", "0123456789abcdef", "f" * 31, "xyz", "\n", "é", "."]
    for _ in range(3000):
        t = "".join(rnd.choices(parts, k=12))
        base = op12.base_spans(t, t.lower())
        assert base == plain_base(t)
        for s, e in op12.candidates(t, t.lower(), base):
            assert all(e <= x or y <= s for x, _, y in base) and e - s >= op12.MIN_CHARS


_CODE = """import client
from service import accounts

def connect(host, port, timeout):
    config = load_config("production")
    session = client.Session(host, port, timeout)
    {line}
    return session.open(accounts.default_account(config))
"""
_KEYS = ["wJalrXUtnFEMI/K7MDENGbPxRfiCYzEXAM4LEKEY", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0", "ghp_2J4mucEQweyR7gxJVifzB1Cx9ObECwJK44eO", "xoxb8Kd02mQzLp77Vw3", "Zq8vR2mXk9Lp4TnW"]
_NAMES = ["load_config_production_v2", "clientSessionHostPortTimeout", "accounts.default_account2", "configLoadConfigClient", "session_timeout_host_port_9"]


def test_novel_strings_are_told_from_names(spark):
    lines = ["headers = {{'Authorization': 'Bearer {}'}}", "client.use(aws_secret_access_key, '{}')", "password is {}", "# webhook {}"]
    texts = [_CODE.format(line=line.format(v)) for line in lines for v in _KEYS + _NAMES]
    texts += [None, "", "x" * 300_000 + " secret " + _KEYS[0] + " " + "secret " * 5000, "no such word " + _KEYS[0], "token = " + _KEYS[3] + " token " + _KEYS[3]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    with Scratch(spark) as scratch:
        got = {r.doc_id: r.spans for r in op12.find_secrets(docs, scratch).collect()}
    for i, t in enumerate(texts[: -5]):
        key = (_KEYS + _NAMES)[i % 10]
        assert [s.text for s in got[i] if s.kind == "novel"] == ([key] if key in _KEYS else []), t
        assert all(t[s.start : s.end] == s.text for s in got[i])
    n = len(texts) - 5
    assert got[n] == got[n + 1] == got[n + 3] == []
    assert [s.text for s in got[n + 2]] == [_KEYS[0]]
    assert [s.kind for s in got[n + 4]] == ["assign", "novel"]  # its copy beside it does not explain it


def test_secrets_empty_and_repeats(spark):
    with Scratch(spark) as scratch:
        assert op12.find_secrets(spark.createDataFrame([], "doc_id long, text string"), scratch).count() == 0
        rows = [(1, "token=12345678"), (1, "token=12345678"), (None, "AKIA" + "A" * 12), (2, None)]
        got = op12.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in got), key=str) == [(1, [("assign", 0, 14)])] * 2 + [(2, []), (None, [("access", 0, 16)])]


def test_a_candidate_begins_with_its_run():
    for t in ("tokenA1b2C3d4E5f6g7", "secret_access_A1b2C3d4E5f6g7"):
        assert op12.candidates(t, t.lower(), []) == []
    assert not op12.looks_keyed("a" * 200_000) and not op12.looks_keyed("12345678901234567890")
