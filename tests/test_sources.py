"""Keyed tables, number ledgers and streams: replays, restarts, late and odd rows."""

import json
import random
import threading
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kgflow.operators import embed as E
from kgflow.sources.keyed import GraphStore, KeyedTable
from kgflow.sources.manifest import Manifest, claim_numbers
from kgflow.streaming import dialogs as DS
from kgflow.streaming import streams as ST


def _files(table):
    return {b: list(f) for b, f in table._snapshot()["files"].items()}


def test_ten_batches_with_replays_equal_one_merge(spark, tmp_path):
    rnd, table = random.Random(1), KeyedTable(spark, f"{tmp_path}/t", "id long, name string, ord long", ["id"], 4)
    want = {}
    for batch in range(10):
        rows = [(rnd.randint(0, 30) if rnd.random() < 0.95 else None, f"{batch}-{i}", rnd.randint(0, 50) * 1000 + batch * 100 + i) for i in range(rnd.randint(0, 12))]
        df = spark.createDataFrame(rows, "id long, name string, ord long").repartition(2)
        assert table.upsert(df, "s", batch)
        assert not table.upsert(df, "s", batch) and not table.upsert(df, "s", max(0, batch - 1))  # replays
        for i, name, o in rows:
            want[i] = max(want.get(i, (-1, "")), (o, name))
        if batch in (4, 7):
            before, full = _files(table), [b for b, f in _files(table).items() if len(f) > 3]
            assert table.compact(3) == sorted(map(int, full))
            after = _files(table)
            assert all(len(after[b]) == 1 if b in full else after[b] == before[b] for b in after)
        assert {r.id: (r.ord, r.name) for r in table.read().collect()} == want
    again = KeyedTable(spark, f"{tmp_path}/t", "id long, name string, ord long", ["id"], 99)  # the table's own number of buckets counts
    assert {r.id: (r.ord, r.name) for r in again.read().collect()} == want and again.buckets == 4
    table.compact(1)
    table.vacuum()
    assert {r.id: (r.ord, r.name) for r in again.read().collect()} == want and max(len(f) for f in _files(table).values()) == 1


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "id long, ord long", ["id"], 8)
    table.upsert(spark.range(100).select("id", F.lit(1).cast("long").alias("ord")))
    before = _files(table)
    table.upsert(spark.createDataFrame([(5, 2)], "id long, ord long"))
    changed = [b for b, f in _files(table).items() if f != before[b]]
    assert len(changed) == 1 and _files(table)[changed[0]][0] == before[changed[0]][0]
    table.upsert(spark.createDataFrame([(5, 2)], "id long, ord long").limit(0))
    assert table.read().count() == 100 and table.read([int(changed[0])]).where("ord = 2").count() == 1


def test_equal_orders_go_to_the_later_upsert(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "id long, name string, ord long", ["id"], 2)
    for name in ("first", "second"):
        table.upsert(spark.createDataFrame([(1, name, 7)], "id long, name string, ord long"))
    assert [r.name for r in table.read().collect()] == ["second"]


def test_nodes_go_before_edges(spark, tmp_path):
    store = GraphStore(spark, f"{tmp_path}/g", "node_id string, ord long", "head string, relation_type string, tail string, ord long", 4)
    node, edge = "node_id string, ord long", "head string, relation_type string, tail string, ord long"
    batches = [([("a", 1), ("b", 1)], [("a", "R", "b", 1), ("a", "R", "c", 1)]), ([("c", 2)], [("c", "R", "a", 2), ("x", "R", None, 2)]), ([], [("a", "R", "c", 3)])]
    for k, (n, e) in enumerate(batches):
        for _ in range(2):
            store.upsert(spark.createDataFrame(n, node), spark.createDataFrame(e, edge), "s", k)
        store.compact(1)
    pairs = lambda t: sorted(((r.head, r.tail) for r in t.read().collect()), key=str)
    assert pairs(store.edges) == [("a", "b"), ("a", "c"), ("c", "a")]
    assert pairs(store.rejects) == [("a", "c"), ("x", None)]


def test_entries_are_put_in_place_once(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.last() == (0, None) and m.append(1, {"a": 1}) and not m.append(1, {"a": 2}) and m.last() == (1, {"a": 1})
    assert m.changed(lambda held: None) is None
    m.append(2, {"a": 2})
    m.prune()
    assert m.last() == (2, {"a": 2}) and len(list((tmp_path / "m" / "entries").glob("0*"))) == 1


def test_numbers_are_given_once(spark, tmp_path):
    ledger, got = f"{tmp_path}/ledger", []
    runs = [threading.Thread(target=lambda n=n: got.append((claim_numbers(spark, ledger, n), n))) for n in (5, 300, 7, 1)]
    for t in runs:
        t.start()
    for t in runs:
        t.join()
    taken = sorted(x for first, n in got for x in range(first, first + n))
    assert taken == list(range(1, 314))
    claim_numbers(spark, ledger, 999_990 - 313)
    rows = spark.range(30).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))
    labels = [r.label for part in (rows, rows, rows.limit(0)) for r in E.number_rows(part, "id", "c_", ledger).collect()]
    assert len(set(labels)) == 60 and {"c_999991", "c_1000000", "c_1000050"} <= set(labels)
    assert [r.label for r in E.number_rows(rows, "id", "c_").orderBy("number").limit(2).collect()] == ["c_000001", "c_000002"]


_TURN = "conv_id long, ts timestamp, turn long, kind string, n_plans int"


def _plain_sessions(turns, idle):
    out = {}
    for conv in {t[0] for t in turns}:
        state, last, n, begun = ("IDLE", 0, 0, 0), None, 0, None
        for _, ts, _, kind, plans in sorted(t for t in turns if t[0] == conv):
            if last is not None and (ts - last).total_seconds() > idle:
                out[conv, begun] = (n, *state)
                state, n = ("IDLE", 0, 0, 0), 0
            begun = ts if n == 0 else begun
            state, n, last = DS.step(state, kind, plans), n + 1, ts
        out[conv, begun] = (n, *state)
    return out


def test_dialogs_over_restarts(spark, tmp_path):
    """Turns in any order within the delay, over three runs of one checkpoint: as the batch fold; idle ones leave no state."""
    rnd, start = random.Random(3), datetime(2024, 5, 1)
    turns = []
    for conv in range(6):
        at = start + timedelta(minutes=rnd.randint(0, 30))
        for k in range(40):
            at += timedelta(seconds=rnd.choice([30, 60, 200, 700, 2500]), microseconds=rnd.randint(0, 999_999))
            turns.append((conv, at, conv * 100 + k, rnd.choice(["query", "reject", "accept", "change", "follow"]), rnd.randint(0, 3)))
    arrival = sorted(turns, key=lambda t: t[1] + timedelta(seconds=rnd.randint(0, 300)))  # at most 300 s late
    told = []
    cuts = [0, 80, 150, len(arrival)]
    for run in range(3):
        part = arrival[cuts[run] : cuts[run + 1]]
        spark.createDataFrame(part, _TURN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(_TURN).parquet(f"{tmp_path}/in")

        def sink(batch, number):
            told.extend((number, *r) for r in batch.collect())

        ST.run_available(DS.stream_dialog_state(stream, 600, "400 seconds"), sink, f"{tmp_path}/checkpoint", "update")
    rows = spark.createDataFrame(told, f"batch long, conv_id long, {DS._STATE}, ended boolean")
    got = {(r.conv_id, r.started): (r.n_turns, r.state, r.idx, r.rejections, r.plans) for r in DS.current_dialogs(rows).collect()}
    assert got == _plain_sessions(turns, 600)
    ended = [t for t in told if t[-1]]
    assert len(ended) == len({t[1:3] for t in ended}) > 20
    batch = DS.dialog_sessions(spark.createDataFrame(turns, _TURN), 600)
    assert {(r.conv_id, r.started) for r in batch.select("conv_id", "started").distinct().collect()} == set(got)


def test_idle_dialogs_leave_no_state(spark, tmp_path):
    start = datetime(2024, 5, 1)
    for k, rows in enumerate([[(c, start, c, "query", 1) for c in range(50)], [(99, start + timedelta(days=1), 1, "query", 1)]]):
        spark.createDataFrame(rows, _TURN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        told = []
        progress = ST.run_available(DS.stream_dialog_state(spark.readStream.schema(_TURN).parquet(f"{tmp_path}/in"), 60, "10 seconds"), lambda b, n, told=told: told.extend(b.collect()), f"{tmp_path}/checkpoint", "update")
    assert sum(r.ended for r in told) == 50
    assert json.loads(progress[-1].json)["stateOperators"][0]["numRowsTotal"] < 10


def test_dialogs_share_the_state_of_their_group(spark, tmp_path):
    """state and calls grow with groups, not with conversations; a batch tells only those that it changed."""
    rnd, start, big = random.Random(5), datetime(2024, 5, 1), 2**60
    at = lambda seconds: start + timedelta(seconds=seconds)
    ids = [None, *range(big, big + 200)]
    turns = [(c, at(rnd.randint(0, 300)), k, rnd.choice(["query", "reject", "accept", "change", "follow"]), rnd.choice([None, 0, 1, 2, 3])) for c in ids for k in range(6)]
    runs = [turns, [(big + 7, at(310), 6, "query", 1)], [(big + 300, at(86_400), 0, "query", 1)]]
    told, states, seen = [], [], []
    for rows in runs:
        spark.createDataFrame(rows, _TURN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream, before = spark.readStream.schema(_TURN).parquet(f"{tmp_path}/in"), len(told)
        progress = ST.run_available(DS.stream_dialog_state(stream, 60, "400 seconds", groups=4), lambda b, n: told.extend((n, *r) for r in b.collect()), f"{tmp_path}/checkpoint", "update")
        states.append(json.loads(progress[-1].json)["stateOperators"][0]["numRowsTotal"])
        seen.append({t[1] for t in told[before:]})
    assert states == [4, 4, 1]
    assert seen == [set(ids), {big + 7}, {*ids, big + 300}]
    rows = spark.createDataFrame(told, f"batch long, conv_id long, {DS._STATE}, ended boolean")
    got = {(r.conv_id, r.started): (r.n_turns, r.state, r.idx, r.rejections, r.plans) for r in DS.current_dialogs(rows).collect()}
    assert got == _plain_sessions([t for rows in runs for t in rows], 60)
    ended = [t for t in told if t[-1]]
    assert len(ended) == len({t[1:3] for t in ended}) == len(got) - 1


def test_late_events_merge_sessions_or_are_counted(spark, tmp_path):
    at = lambda m: datetime(2024, 5, 1) + timedelta(minutes=m)
    runs = [
        [("u", at(0), 1.0), ("u", at(20), 2.0), ("v", at(5), 1.0)],
        [("u", at(10), 4.0), ("w", at(60), 1.0)],  # joins the two sessions of u
        [("w", at(300), 1.0)],
        [("u", at(100), 8.0), ("v", at(90), 8.0), ("w", at(295), 2.0)],  # two of them come behind the watermark
        [("w", at(1000), 1.0)],
    ]
    told, dropped = [], 0
    for rows in runs:
        spark.createDataFrame(rows, "user string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("user string, ts timestamp, value double").parquet(f"{tmp_path}/in")
        sessions = ST.event_sessions(stream, "ts", "user", "12 minutes", "60 minutes")
        dropped += ST.dropped_late(ST.run_available(sessions, lambda b, n: told.extend(b.collect()), f"{tmp_path}/checkpoint"))
    got = sorted((r.user, r.session.start, r.n, r.total) for r in told)
    assert got == [("u", at(0), 3, 7.0), ("v", at(5), 1, 1.0), ("w", at(60), 1, 1.0), ("w", at(295), 2, 3.0)]
    assert dropped == 2


class _Fails:
    def __init__(self):
        self.calls = 0

    def __call__(self, texts):
        self.calls += 1
        if any(t == "bad" for t in texts):
            raise RuntimeError("cannot read this")
        return [[1.0, float(len(t))] if t != "short" else [1.0] for t in texts]


def test_embedding_fails_for_single_texts_only(spark):
    rows = [(i, ["fine", "bad", "short", "", None, "x" * 9][i % 6] if i < 30 else f"text {i}") for i in range(200)]
    nodes = spark.createDataFrame(rows, "node_id long, body string").repartition(3)
    none = spark.createDataFrame([(150, "embed", "done"), (151, "embed", "failed")], "node_id long, stage string, status string")
    ok, bad = E.embed_batches(nodes, none, "body", _Fails, 2)
    good = {r.node_id: r.embedding for r in ok.collect()}
    assert good == {i: [1.0, float(len(t))] for i, t in rows if t not in ("bad", "short", "", None) and i != 150}
    reasons = pd.Series({r.node_id: r.reason for r in bad.collect()})
    assert sorted(reasons.index) == sorted(i for i, t in rows if t in ("bad", "short", "", None))
    assert set(reasons) == {"RuntimeError: cannot read this", "1 numbers instead of 2", "no text"}
    ok, bad = E.embed_batches(nodes.limit(0), none, "body", _Fails, 2)
    assert ok.count() == bad.count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from kgflow.sources.scratch import scratch_path

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {"spark.checkpoint.dir": None})

    with pytest.raises(ValueError):
        scratch_path(Session, "x")
