"""Operators 3, 5, 7, 10 and the components they share, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from kgflow.llm import common, op03_pivot_dedup, op05_ngram_jaccard, op07_line_dedup, op10_exact_dedup
from kgflow.llm.common import connected_components, table


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({n for e in edges for n in e}, edges)
    touched = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in want.items() if n in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def near_copies(n, words, seed):
    """Families of near copies with a few changed words, exact copies, short and empty texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one two"), (4, "ONE two"), (5, "one"), (6, "x y z"), (7, "X Y z")]
    while len(rows) < n:
        base = [rng.choice(vocab) for _ in range(rng.randint(3, words))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    return rows


def brute_jaccard(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    where, links = {}, []
    for i, s in sets.items():
        common = Counter(j for x in s for j in where.get(x, ()))
        links += [(i, j) for j, n in common.items() if den * n >= num * (len(s) + len(sets[j]) - n)]
        for x in s:
            where.setdefault(x, []).append(i)
    c = components(sets, links)
    return {i: (len(s), c[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num", "words", "block"), [(3, 90, 120, 512), (5, 80, 60, 512), (5, 80, 60, 4), (3, 90, 200, 3), (2, 50, 40, 5), (1, 30, 40, 512), (3, 100, 60, 512)])
def test_ngram_jaccard(spark, monkeypatch, k, num, words, block):
    whole = op05_ngram_jaccard.verified_links
    monkeypatch.setattr(op05_ngram_jaccard, "verified_links", lambda f, a, b, scratch: whole(f, a, b, scratch, block))
    monkeypatch.setattr(op05_ngram_jaccard, "CHUNK", 3000)
    rows = near_copies(700, words, k + block)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cluster string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op05_ngram_jaccard.ngram_jaccard(df, k=k, num=num).collect()}
    assert got == brute_jaccard(rows, k, num, 100)


def test_ngram_jaccard_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op05_ngram_jaccard.query(spark, sf).collect()}
    assert got == brute_jaccard(rows, 3, 90, 100)


def test_ngram_jaccard_edge_cases(spark):
    df = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (3, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in op05_ngram_jaccard.ngram_jaccard(df, k=3).collect())
    assert [g[1:] for g in got] == [(3, 2, 3), (7, 2, 3), (7, 2, 3), (None, 2, 3)]
    assert op05_ngram_jaccard.ngram_jaccard(df.limit(0)).collect() == []


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ngram_jaccard_without_shared_shingles(spark, many_partitions):
    """Buckets and chunks in which no shingle, or no tile, is shared."""
    schema = "doc_id long, text string"
    one = op05_ngram_jaccard.ngram_jaccard(spark.createDataFrame([(4, "a b c d e f")], schema), k=3)
    assert [tuple(r) for r in one.select("doc_id", "n_shingles", "component_id").collect()] == [(4, 4, 4)]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(40)]
    got = op05_ngram_jaccard.ngram_jaccard(spark.createDataFrame(rows, schema), k=3).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, 18, i) for i in range(40)]
    rows += [(100 + i, " ".join([f"v{i}x{k}" for k in range(30)] + ["one", "common", "end"])) for i in range(2)]  # shared, but not among the rarest
    got = op05_ngram_jaccard.ngram_jaccard(spark.createDataFrame(rows, schema), k=3).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 42


def test_ngram_jaccard_over_many_partitions(spark, sf, many_partitions):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op05_ngram_jaccard.query(spark, sf).collect()}
    assert got == brute_jaccard(docs, 3, 90, 100)


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 500, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        differ = int(np.bitwise_count(op05_ngram_jaccard.bitmap(a) ^ op05_ngram_jaccard.bitmap(b)).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) / 2


def vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        rows.append((i, [float(x) for x in v], int(i % 3)))
        for _ in range(int(rng.integers(0, 3))):
            rows.append((n + len(rows), [float(x) for x in v + rng.normal(size=dim) * rng.choice([0, 0.02, 0.2])], int(i % 3)))
    odd = [(9001, None, 1), (9002, [0.0] * dim, 1), (9003, [float("nan")] * dim, 1), (9004, [None] + [1.0] * (dim - 1), 1), (9005, [1.0] * dim, None), (9006, [], 1), (9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1)]
    return rows + odd


def brute_cosine(rows, threshold):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0 and lab is not None]
    links = [(a[0], b[0]) for n, a in enumerate(ok) for b in ok[:n] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold]
    n, c = Counter(x for link in links for x in link), components([r[0] for r in rows], links)
    return {r[0]: (n[r[0]], c[r[0]], c[r[0]] == r[0]) for r in rows}


def test_pivot_dedup_recall_at_the_threshold(spark):
    """Vectors without any structure and, for each, one of a cosine just above the threshold: the hardest links."""
    rng, rows = np.random.default_rng(12), []
    unit = lambda v: v / np.linalg.norm(v)
    for i in range(2500):
        x = unit(rng.normal(size=64))
        g = rng.normal(size=64)
        y = 0.931 * x + np.sqrt(1 - 0.931**2) * unit(g - (g @ x) * x)
        rows += [(2 * i, x.tolist(), i % 2), (2 * i + 1, y.tolist(), i % 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for pivots in (256, 1024, 2048):
        found = op03_pivot_dedup.pivot_dedup(df, pivots=pivots).where("n_links > 0").count() / len(rows)
        print(f"recall with {pivots} pivots: {found:.4f}")
        assert found >= 0.99


@pytest.mark.parametrize("block", [1024, 3])
def test_pivot_dedup(spark, block):
    rows = vectors(block)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op03_pivot_dedup.pivot_dedup(df, block=block).collect()}
    want = brute_cosine(rows, 0.93)
    found, all_ = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found >= 0.9 * all_ and all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)
    assert op03_pivot_dedup.pivot_dedup(df.limit(0)).collect() == []


def test_pivot_dedup_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf, "embeddings").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op03_pivot_dedup.query(spark, sf).collect()}
    assert got == brute_cosine(rows, 0.93)


def test_pivot_dedup_edge_cases(spark):
    df = spark.createDataFrame([(7, [1.0, 0.0], 1, "a"), (7, [2.0, 0.0], 1, "b"), (7, [0.0, 1.0], 1, "c"), (3, [0.0, 3.0], 1, "d"), (None, [1.0, 0.0], 1, "e"), (9, [3.0, 4.0], 1, "f"), (8, [4.0, 3.0], 1, "g")], "vec_id long, embedding array<double>, label int, node string")
    got = sorted(tuple(r) for r in op03_pivot_dedup.pivot_dedup(df).collect() if r.vec_id is not None)
    assert got == [(3, 1, 3, True), (7, 1, 3, False), (7, 2, 7, True), (7, 2, 7, True), (8, 1, 8, True), (9, 1, 8, False)]  # 24 / 25 is 0.96
    assert [(r.n_links, r.component_id) for r in op03_pivot_dedup.pivot_dedup(df).where("vec_id IS NULL").collect()] == [(2, 7)]
    at = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.93, 0.93**2 - 1], 1), (3, [0.6, 0.8], 1), (4, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    tie = {r.vec_id: r.n_links for r in op03_pivot_dedup.pivot_dedup(at, threshold=0.6).collect()}
    assert tie == {1: 3, 2: 2, 3: 2, 4: 3}  # the cosine of 3 and 1 is the threshold


def test_pivot_dedup_of_extreme_norms(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [1.0, 1.0], 1), (4, [1e308, -1e308], 1), (5, [5e-324, 0.0], 1), (6, [1.0, 0.0], 1), (7, [0.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op03_pivot_dedup.pivot_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_pivot_dedup_finds_all_links_of_dense_topics(spark):
    rng, dim, rows = np.random.default_rng(5), 64, []
    for _ in range(2):
        topic = 2 * (t := rng.normal(size=dim)) / np.linalg.norm(t)
        for _ in range(300):
            v = topic + rng.normal(size=dim) / 8
            rows += [(len(rows) + k, (v + k * rng.normal(size=dim) * 0.08).tolist(), 1) for k in (0, 1)]
    want = brute_cosine(rows, 0.93)
    assert sum(w[0] for w in want.values()) >= 400
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (1024, 100):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op03_pivot_dedup.pivot_dedup(df, block=block).collect()}
        assert got == want


def brute_lines(rows, min_chars=1):
    seen = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
            if len(line) >= min_chars and any(c.isalnum() for c in line):
                seen.setdefault(line, []).append((i, n))
    lines, k = list(seen), op07_line_dedup.SHINGLE
    sets, where, links = [], {}, []
    for i, line in enumerate(lines):
        s = {line[j : j + k] for j in range(max(1, len(line) - k + 1))}
        common = Counter(j for x in s for j in where.get(x, ()))
        links += [(i, j) for j, n in common.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)]
        sets.append(s)
        for x in s:
            where.setdefault(x, []).append(i)
    c = components(range(len(lines)), links)
    stays = {}
    for i, line in enumerate(lines):
        stays[c[i]] = min(stays.get(c[i], min(seen[line])), min(seen[line]))
    gone = {at for i, line in enumerate(lines) for at in seen[line] if at != stays[c[i]]}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_line_dedup(spark, sf):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("an", "el", "ir", "ov", "up")]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "short\nshort"), (3, "x" * 30000 + "\n" + "X" * 30000)]
    for i in range(4, 120):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.1 else x.replace("an", "en", 1) if rng.random() < 0.2 else x for x in lines)))
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, node string")
    assert {r.doc_id: r.text for r in op07_line_dedup.line_dedup(df).collect()} == brute_lines(rows)
    assert {r.doc_id: r.text for r in op07_line_dedup.line_dedup(df, min_chars=20).collect()} == brute_lines(rows, 20)
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert {r.doc_id: r.text for r in op07_line_dedup.query(spark, sf).collect()} == brute_lines(docs)
    assert op07_line_dedup.line_dedup(df.limit(0)).collect() == []


def test_line_dedup_compares_all_lines_of_a_family(spark):
    rng = random.Random(11)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 1)) + "."
    shared, lines = "." + own(99), []
    for _ in range(600):  # J of 0.75 or so to each other, of 0.86 to the own near copy
        field = own(15)
        lines += [shared + field, shared + field[:7] + "#" + field[8:]]
    rng.shuffle(lines)
    rows = [(i, f"{line}\n--") for i, line in enumerate(lines)]
    want = brute_lines(rows)
    assert 600 <= sum(t == "--" for t in want.values()) < 620
    for parts in (2, 24):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert {r.doc_id: r.text for r in op07_line_dedup.line_dedup(df).collect()} == want


def test_line_dedup_edge_cases(spark):
    line = "a line of the corpus that comes twice or more"
    rows = [(2, f"{line}\nown two", 9, "u"), (2, f"own two\n{line.upper()} \n}}\n}}", 9, "v"), (2, f"{line}\nown two", 9, "w"), (1, None, 9, "x"), (None, line, 9, "y"), (3, "", 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, k string")
    got = {r.k: (r.text, r.n_lines, r.n_removed) for r in op07_line_dedup.line_dedup(df).collect()}
    assert got["u"] == got["w"] and {got["x"], got["y"], got["z"]} == {(None, 0, 0), (line, 1, 0), ("", 1, 0)}
    assert sorted([got["u"], got["v"]]) in ([("", 2, 2), (rows[1][1], 4, 0)], [(rows[0][1], 2, 0), ("}\n}", 4, 2)])


def exchanged(plan):
    """Bytes that the exchanges of an executed plan have dealt."""
    name, children = plan.getClass().getSimpleName(), plan.children()
    own = plan.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0
    inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    return own + (exchanged(inner) if inner is not None else 0) + sum(exchanged(children.apply(i)) for i in range(children.size()))


def test_line_dedup_shuffles_no_text_that_keeps_its_lines(spark):
    rng = random.Random(11)
    rows = [(i, "\n".join(" ".join(str(rng.randrange(10**9)) for _ in range(40)) for _ in range(6))) for i in range(200)]
    rows += [(200, rows[3][1].split("\n")[2] + "\nmore words"), (201, None), (202, "")]
    done = op07_line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in done.collect()}
    assert got == {i: (t, t.count("\n") + 1 if t is not None else 0, 0) for i, t in rows} | {200: ("more words", 2, 1)}
    assert 0 < exchanged(done._jdf.queryExecution().executedPlan()) < sum(len(t or "") for _, t in rows) / 10


def test_sieve_lets_all_its_keys_pass_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(common, "_SIEVE_LEAST", 1 << 12)
    keys = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 6000)
    sieve = common.Sieve(spark.createDataFrame([(int(k),) for k in keys[:2000]], "key long").union(spark.createDataFrame([(int(keys[0]),)], "key long")))
    assert sieve.bits == 1 << 15 and sieve.passes(keys[:2000]).all() and sieve.passes(keys[2000:]).mean() < 0.03
    assert not common.Sieve(spark.createDataFrame([], "key long")).passes(keys).any()
    monkeypatch.setattr(common, "_SIEVE_MOST", 1 << 11)  # full: others pass too, and no key is lost
    full = common.Sieve(spark.createDataFrame([(int(k),) for k in keys[:2000]], "key long"))
    assert full.bits == 1 << 11 and full.passes(keys[:2000]).all()


def test_band_signatures_estimate_similarity():
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    near = base[:200] + "#" + base[201:]
    a, b = op07_line_dedup.band_signatures([base, near])
    assert (a == b).any() and not (op07_line_dedup.band_signatures(["".join(rng.choice("xyz ") for _ in range(400))])[0] == a).any()


@pytest.mark.parametrize(("fan_in", "rounds"), [(8, 2), (2, 3), (4, 1), (8, None)])
def test_exact_dedup(spark, fan_in, rounds):
    rng = random.Random(rounds)
    rows = [(i, rng.choice([None, "", "Hot", "hot", "HOT", "É", "é", f"t{rng.randrange(40)}", "long " * 2000]), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(7)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in op10_exact_dedup.exact_dedup(df, fan_in=fan_in, rounds=rounds).collect()}
    lower = lambda t: (t or "").encode().lower()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    assert got == {i: (max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)])) for i, t, _ in rows}
    assert op10_exact_dedup.exact_dedup(df.limit(0)).collect() == []


def test_runs_are_sorted_and_merge_at_every_level(spark):
    rng = np.random.default_rng(8)

    def records(n):
        out = np.zeros(n, op10_exact_dedup.RECORD)
        out["digest"], out["check"] = rng.integers(0, 40, (n, 1)).astype("u8") << np.uint64(58), 7
        out["digest"][:, 1] = rng.integers(0, 2, n)
        out["id"], out["known"], out["n"] = rng.integers(0, 1000, n), rng.random(n) < 0.9, 1
        return out

    key = lambda r: [tuple(d) for d in r["digest"].tolist()]
    parts = [records(300) for _ in range(5)]
    runs = [op10_exact_dedup.collapse(p) for p in parts]
    merged = op10_exact_dedup.collapse(np.concatenate(runs))
    for run in [*runs, merged]:
        assert key(run) == sorted(set(key(run)))
    whole, want = np.concatenate(parts), {}
    for k, i, known in zip(key(whole), whole["id"].tolist(), whole["known"].tolist(), strict=True):
        have = want.setdefault(k, [0, None])
        want[k] = [have[0] + 1, max(have[1] if have[1] is not None else -1, i) if known else have[1]]
    assert {k: [n, i if known else None] for k, n, i, known in zip(key(merged), merged["n"].tolist(), merged["id"].tolist(), merged["known"].tolist(), strict=True)} == want
    place = dict(op10_exact_dedup.exchange(merged, 0b010101, 0, 2, 3))
    assert sum(map(len, place.values())) == len(merged) and all(n & 7 == 0b101 and (p["digest"][:, 0] >> np.uint64(61) == n >> 3).all() for n, p in place.items())
    df = spark.createDataFrame([(1, b"\0" * 32, 1)], "doc_id long, digest binary, check long")
    plan = op10_exact_dedup.merge_runs(df, fan_in=2, rounds=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 4 and plan.count("Sort [run") == 3


def test_exact_dedup_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in op10_exact_dedup.exact_dedup(df, keep="min").collect()))
    assert rows == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
