"""Operators 4 and 6, the registry and the pipeline."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from kgflow.llm import op01_bpe, op04_mixing, op06_token_counts, op08_quality_gam, registry
from kgflow.llm.common import scratch_path, table

TABLES = "documents embeddings pages labels".split()


def _normal(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted([tuple(_normal(r[c]) for c in cols) for r in df.collect()], key=repr)
    con.execute(registry.SQL[name])
    have = [d[0] for d in con.description]
    assert sorted(have) == cols
    assert got == sorted([tuple(_normal(r[have.index(c)]) for c in cols) for r in con.fetchall()], key=repr)


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


def _mix(spark, rows, labels=()):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = op04_mixing.mix_sources(docs, spark.createDataFrame(list(labels), "doc_id long, quality int"))
    return docs, got.collect()


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (i % 37 + 1), None if i % 4 == 3 else f"s{i % 4}", "x") for i in range(2000)]
    _, got = _mix(spark, rows, [(1, 1), (2, 0)])
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r.source, [r.target, r.source_size, 0])
        t[2] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert abs(sum(t[0] for t in by.values()) - 1.5 * total) < 1e-6
    for target, size, taken in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 37
    again = _mix(spark, list(reversed(rows)), [(1, 1), (2, 0)])[1]
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixing_edge_cases(spark):
    assert _mix(spark, [])[1] == []
    assert {(r.size, r.target, r.taken) for r in _mix(spark, [(1, None, "a", ""), (2, "", None, "")])[1]} == {(0, 0.0, 0)}
    docs = [(5, "a b c", "s", ""), (5, "a b c", "s", ""), (None, "d", "s", "")]
    assert len(_mix(spark, docs)[1]) == 3


def test_mixing_prefers_quality(spark):
    rows = [(i, "w w", "only" if i < 1000 else "z", "") for i in range(3000)]
    got = _mix(spark, rows, [(i, i % 2) for i in range(3000)])[1]
    z = [r for r in got if r.source == "z"]
    picked = [r.doc_id % 2 for r in z if r.copies > min(x.copies for x in z)]
    assert picked and sum(picked) / len(picked) > 0.55


SCHEMA = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def test_rollup_commits_once_and_nets_out(spark):
    roll = op06_token_counts.TokenRollup(spark, scratch_path(spark, "rollup-test"))
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    assert roll.totals().collect() == [] and not roll.compact()
    assert roll.commit(1, batch(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, "en", "v1", None, None), ("noise", "a", "en", "v1", 99, 1)))
    assert not roll.commit(1, batch(("insert", "a", "en", "v1", 10, None)))
    assert roll.commit(5, batch(("revise", "a", "en", "v1", 7, 10), ("delete", "a", "en", "v1", 5, None), ("insert", "b", "en", "v1", 1, None), ("delete", "b", "en", "v1", 1, None)))
    want = {("a", "en", "v1", 1, 7), (None, "en", "v1", 1, 0)}
    assert {tuple(r) for r in roll.totals().collect()} == want
    assert roll.compact() and not roll.compact()
    assert not roll.commit(5, batch(("insert", "a", "en", "v1", 10, None)))
    assert roll.commit(3, spark.createDataFrame([], SCHEMA)) and {tuple(r) for r in roll.totals().collect()} == want
    assert roll.commit(4, batch(("insert", "a", "en", "v1", 1, None))) and roll.compact()
    other = op06_token_counts.TokenRollup(spark, roll.root)
    assert {tuple(r) for r in other.totals().collect()} == {("a", "en", "v1", 2, 8), (None, "en", "v1", 1, 0)}


def test_rollup_takes_one_of_two_commits_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    root = scratch_path(spark, "rollup-race")
    rows = spark.createDataFrame([("insert", "a", "en", "v1", 10, None)], SCHEMA)
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: op06_token_counts.TokenRollup(spark, root).commit(1, rows), range(4)))
    assert sum(done) == 1
    assert [tuple(r) for r in op06_token_counts.TokenRollup(spark, root).totals().collect()] == [("a", "en", "v1", 1, 10)]


def test_token_counts_equal_the_library(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = ["", None, "  a  b ", "A<|endoftext|>b <|startoftext|> c", "tab\tand\nline\r\n", "é\u0301 ﬁ ½ 日本", "x" * 3000, "don't we'll  1234", "a  b\n\n c\t\td   ", "x\0y \0 z", "\u3000a\u00a0b\u2003c"]
    docs = [(r.doc_id, r.source, r.lang, r.text) for r in table(spark, sf, "documents").collect()] + [(10**6 + i, None, "xx", t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string")
    plain = {}
    for name in op06_token_counts.TOKENIZERS:
        t = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        t.no_truncation()
        t.no_padding()
        plain[name] = lambda text, t=t: len(t.encode(text or "", add_special_tokens=False).ids)
    for r in op06_token_counts.count_tokens(df).collect():
        text = next(d[3] for d in docs if d[0] == r.doc_id)
        assert {n: r[n] for n in plain} == {n: f(text) for n, f in plain.items()}, text
    assert op06_token_counts.count_tokens(df.limit(0)).collect() == []
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    want = {}
    for i, source, lang, text in docs[: -len(odd)]:
        l = labels.get(i)
        for n, f in plain.items():
            if l is None or l.toxic != 1:
                low = n == "byte_bpe_50k" and l is not None and l.quality == 0
                have = want.setdefault((source, lang, n), [0, 0])
                have[0], have[1] = have[0] + 1, have[1] + f(text) + low
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in op06_token_counts.query(spark, sf).collect()}
    assert got == want


def plain_mix(docs, quality):
    """How often each of (doc_id, source, text) is taken, by the rules of op4 in plain Python."""
    sized = {}
    for i, source, text in docs:
        u = (int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        sized.setdefault(source, []).append((-math.log(u) / {1: 2.0, 0: 0.5}.get(quality.get(i), 1.0), i, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    sources = sorted(sized, key=lambda s: (s is None, s or ""))
    size, weight = {s: sum(x[2] for x in sized[s]) for s in sources}, {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * size[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left, free = left - sum(target[s] for s in full), free - full
    copies = {}
    for s in sources:
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, upto, rows = target[s] - epochs * size[s], 0, sorted(sized[s])
        taken = 0
        while taken < len(rows) and upto + rows[taken][2] <= rest:
            upto, taken = upto + rows[taken][2], taken + 1
        chosen, gap = {x[1] for x in rows[:taken]}, rest - upto
        more = [(abs(gap - n), key, i) for key, i, n in rows[taken:] if abs(gap - n) < gap]
        if more:
            chosen.add(min(more)[2])
        copies |= {i: min(2, epochs + (i in chosen)) for _, i, _ in rows}
    return copies


def plain_score(model, text):
    x, total = op08_quality_gam.features(text), model.base
    bins = [sum(v >= c for c in cuts) for v, cuts in zip(x, model.cuts)]
    for b, t in zip(bins, model.tables):
        total += t[b]
    for (i, j), t in zip(model.pairs, model.pair_tables):
        total += t[bins[i]][bins[j]]
    return 1 / (1 + math.exp(-total))


def test_pipeline_equals_a_plain_version(spark, sf):
    from tests.llm.test_dedup_ops import brute_jaccard, brute_lines

    docs = [(r.doc_id, r.source, r.text) for r in table(spark, sf, "documents").collect()]
    quality = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    taught = sorted((i, quality[i], op08_quality_gam.features(t)) for i, _, t in docs if i in quality and zlib.crc32(str(i).encode()) % 5)
    model = op08_quality_gam.fit(np.array([t[2] for t in taught], float), np.array([t[1] for t in taught], float))
    kept = [d for d in docs if plain_score(model, d[2]) >= 0.3]
    cut = brute_lines([(i, t) for i, _, t in kept])
    kept = [(i, s, cut[i]) for i, s, t in kept if cut[i] == t or cut[i].strip(" ")]
    groups = brute_jaccard([(i, t) for i, _, t in kept], 5, 80, 100)
    kept = [d for d in kept if groups[d[0]][1] == d[0]]
    copies = plain_mix(kept, quality)
    tokenizer, want = op01_bpe.load(op01_bpe.default_path()), []
    for i, _, t in kept:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want += [(i, len(ids), ids, hashlib.sha256(t.encode()).hexdigest())] * copies[i]
    assert 0 < len(kept) < len(docs) and len(set(copies.values())) > 1
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids", "decoded_sha256").collect()) == sorted(want)


def test_pipeline_over_many_partitions(spark, sf):
    rows = lambda: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    few, before = rows(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        assert rows() == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pipeline_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    first = {r.doc_id for r in corpus_pipeline.quality(spark, table(spark, sf, "documents"), sf).select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in first for i in good) / len(good) > 0.98


def test_stages_take_odd_rows(spark, sf):
    names = "doc_id long, text string, lang string, source string, n_chars long, n_removed int, predicted string, component_id string, copies string"
    text = "the same five words in a row and then some more of them to fill a line"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text.upper(), "en", None), (3, None, None, "b"), (4, "", "en", "b"), (None, "no id here", "en", "b"), (5, "w " * 60_000, "en", "c")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, "p", "q", "r") for r in rows], names)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        if stage is not corpus_pipeline.tokens:
            assert got.columns == docs.columns, name
            assert {tuple(r[c] for c in ("n_removed", "predicted", "component_id", "copies")) for r in got.collect()} <= {(7, "p", "q", "r")}, name
        assert stage(spark, docs.limit(0), sf).collect() == [], name
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.lines(spark, docs, sf).where("doc_id IN (1, 2)").collect()) == [(1, text), (1, text)]
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf).collect()} == {1, 3, 4, None, 5}
    other = "quite another text of more than five words that nobody else has"
    twice = spark.createDataFrame([(1, text), (2, text), (2, other), (None, text), (None, "no copy of anything at all here"), (3, other)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, twice, sf).collect()), key=str) == [(1, text), (2, other), (None, "no copy of anything at all here")]
    assert corpus_pipeline.tokens(spark, docs, sf).count() == len(rows)


def test_empty_documents_are_taken_twice_at_most(spark):
    _, got = _mix(spark, [(1, "w", "a", ""), (2, "", "a", ""), (3, "w " * 500, "b", "")])
    assert max(r.copies for r in got) <= 2


def test_repeated_ids_teach_once(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 40 + [(2, "x"), (2, "y"), (3, "z z z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    model = op08_quality_gam.train(docs, labels)
    known = sorted((i, q, op08_quality_gam.features(t)) for i, q, t in [(1, 1, "a b c"), (2, 0, "x"), (3, 1, "z z z")] if zlib.crc32(str(i).encode()) % 5)
    want = op08_quality_gam.fit(np.array([k[2] for k in known], float), np.array([k[1] for k in known], float))
    scores = op08_quality_gam.classify(docs, model).collect()
    assert len(scores) == 43 and all(abs(r.score - plain_score(want, r.text)) < 1e-12 for r in scores)


def test_vocabularies_are_not_in_the_repository():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for d, _, fs in os.walk(top) for f in fs if f.endswith((".tiktoken", ".model")) or f.startswith("byte_bpe")]
