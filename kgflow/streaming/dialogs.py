"""Conversations as keyed state: turns wait for the watermark, are folded in order, and idle conversations end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def step(state: tuple, kind: str, n_plans: int, most: int = 3) -> tuple:
    """One turn: (state, idx, rejections, plans), as kgflow.operators.dialog.next_state has it."""
    name, idx, rejections, plans = state
    if name == "REFUSED":
        return "PRESENTING", idx, rejections, plans
    if name in ("IDLE", "COMPLETED") or kind == "change":
        return ("PRESENTING" if n_plans is not None and n_plans > 0 else "COMPLETED"), 0, 0, n_plans
    if kind == "accept":
        return "COMPLETED", idx, rejections, plans
    if kind == "reject":
        ended = rejections + 1 >= most or idx >= plans - 1
        return ("COMPLETED" if ended else "REFUSED"), (idx if ended else idx + 1), rejections + 1, plans
    return state


_STATE = "started long, last long, n_turns long, state string, idx int, rejections int, plans int"
#: A conversation before its first turn: the values of _STATE; times in microseconds.
_NEW = (0, 0, 0, "IDLE", 0, 0, 0)
_TOLD = ["conv_id", "started", "last", "n_turns", "state", "idx", "rejections", "plans", "ended"]


def fold(conversation: tuple, turns: list[tuple], idle: int, most: int) -> tuple[tuple, list[tuple]]:
    """Takes turns (ts, turn, kind, n_plans) in order: the conversation that is open then, and those that ended by a gap."""
    ended = []
    started, last, n_turns, *now = conversation
    for ts, _, kind, n_plans in turns:
        if n_turns and ts - last > idle:
            ended.append((started, last, n_turns, *now))
            n_turns, now = 0, _NEW[3:]
        started = started if n_turns else ts
        last, n_turns, now = ts, n_turns + 1, step(now, kind, n_plans, most)
    return (started, last, n_turns, *now), ended


def _order(turn: tuple) -> tuple:
    ts, number, kind, n_plans = turn
    return ts, number, kind or "", -1 if n_plans is None else n_plans


def _plans(column: pd.Series) -> list:
    """pandas makes fractions of whole numbers among which some are null."""
    return [None if pd.isna(n) else int(n) for n in column.tolist()] if column.hasnans else column.astype(int).tolist()


class _Dialogs(StatefulProcessor):
    """Keyed value state of a group (its open conversations and the turns that wait) and one event-time timer a group."""

    def __init__(self, idle: int, most: int):
        self.idle, self.most = idle, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = f"conv_id string, {_STATE}, waiting_id string, ts long, turn long, kind string, n_plans int"
        lists = ", ".join(f"{name} array<{kind}>" for name, kind in (column.split() for column in held.split(", ")))
        self.held = handle.getValueState("conversations", f"timer long, {lists}")

    def _advance(self, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """new: (conv_id, ts, turn, kind, n_plans)."""
        held = self.held.get()
        opened = {conv: tuple(values) for conv, *values in zip(*held[1:9], strict=True)} if held else {}
        turns: dict = {}
        for conv, *turn in [*(zip(*held[9:], strict=True) if held else ()), *new]:
            turns.setdefault(conv, []).append(tuple(turn))
        fresh = {row[0] for row in new}
        rows, keep, wait, timer = [], [], [], None
        for conv in opened.keys() | turns.keys():
            before, waiting = opened.get(conv, _NEW), sorted(turns.get(conv, ()), key=_order)
            due = [t for t in waiting if t[0] <= watermark]  # nothing older can come
            waiting = waiting[len(due) :]
            now, ended = fold(before, due, self.idle, self.most)
            if now[2] and not waiting and now[1] + self.idle < watermark:
                ended.append(now)
                now = _NEW
            if now[2]:
                keep.append((conv, *now))
            wait += [(conv, *t) for t in waiting]
            if now[2] or waiting:
                at = waiting[0][0] if waiting else now[1] + self.idle + 1
                timer = at if timer is None else min(timer, at)
            if conv in fresh or due or ended:
                live, crossed = fold(now, waiting, self.idle, self.most)
                rows += [(conv, *c, True) for c in ended]
                if live[2]:
                    rows += [(conv, *c, False) for c in (*crossed, live)]
        if held:
            self.handle.deleteTimer(held[0])
        if timer is None:
            self.held.clear()
        else:
            timer = -(-timer // 1000)
            self.handle.registerTimer(timer)
            lists = [list(c) for part, n in ((keep, 8), (wait, 5)) for c in (zip(*part, strict=True) if part else [()] * n)]
            self.held.update((timer, *lists))
        if rows:
            yield pd.DataFrame(rows, columns=_TOLD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [row for pdf in rows for row in zip(*(pdf[c].tolist() for c in ("conv_id", "at", "turn", "kind")), _plans(pdf["n_plans"]), strict=True)]
        yield from self._advance(new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def stream_dialog_state(turns: DataFrame, idle: int, late: str, most: int = 3, groups: int = 4096) -> DataFrame:
    """turns(conv_id, ts, turn, kind, n_plans): the conversations that a batch changed, for a query in update mode.

    A conversation ends when no turn follows within ``idle`` seconds; its state goes and a later turn begins a new one.
    Turns count in the order of (ts, turn), whatever batch they come in: they wait until the watermark, ``late`` behind
    the latest turn, has passed them, and older ones are dropped, as Spark's watermark says.  Rows with ``ended`` are
    final, one a conversation; the others tell the state as of all turns so far, and the next batch that has rows of
    the conv_id replaces them (``current_dialogs``).  The query needs the RocksDB state store (``run_available`` sets it).

    Conversations are dealt into ``groups`` by hash, and a group is a key of the state: a call of Python, its data frames
    and its messages to the state store cost the same for one conversation as for a hundred.  A batch writes the state of
    the groups it has turns of, so a group should stay small; a checkpoint holds the number it began with.
    """
    conv = F.col("conv_id").cast("string").alias("conv_id")  # pandas would round large numbers among which some are null
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)).alias("turn")  # null last
    group = F.pmod(F.xxhash64("conv_id"), F.lit(groups)).alias("group")
    timed = turns.withWatermark("ts", late).select(group, conv, "ts", F.unix_micros("ts").alias("at"), turn, "kind", F.col("n_plans").cast("int").alias("n_plans"))
    told = timed.groupBy("group").transformWithStateInPandas(_Dialogs(idle * 1_000_000, most), f"conv_id string, {_STATE}, ended boolean", "update", "EventTime")
    return told.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def current_dialogs(rows: DataFrame) -> DataFrame:
    """rows of ``stream_dialog_state`` with the number of their batch: all that ended, and the latest of those that did not."""
    newest = F.max("batch").over(Window.partitionBy("conv_id"))
    told = rows.withColumn("newest", newest).where("ended OR batch = newest")
    return told.select("conv_id", F.timestamp_micros("started").alias("started"), "n_turns", "state", "idx", "rejections", "plans", "ended")


def dialog_sessions(turns: DataFrame, idle: int) -> DataFrame:
    """turns(conv_id, ts, turn, ...) with started: when the conversation of the turn began; the batch form of the same split."""
    w = Window.partitionBy("conv_id").orderBy("ts", "turn")
    first = F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > idle * 1_000_000, F.lit(True))
    return turns.withColumn("started", F.last(F.when(first, F.col("ts")), ignorenulls=True).over(w))
