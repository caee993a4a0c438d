"""Stateful sessions and event windows, by the same functions in batch and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "key long, answered long, correct long, wrong long, remaining long, active boolean, finished boolean"


class Session:
    """A run through a queue of questions: a right answer removes the first; a wrong one counts and, when missed questions
    come back, moves it to the end, else removes it; a skip moves it to the end; restart refills, stop empties."""

    def __init__(self, questions: int, recycle: bool):
        self.questions, self.recycle = questions, recycle
        self.restart()

    def restart(self) -> None:
        self.queue = deque(range(self.questions))
        self.answered = self.correct = self.wrong = 0
        self.active = True

    def take(self, action: str) -> None:
        if action == "restart":
            self.restart()
        elif action == "stop":
            self.restart()
            self.queue.clear()
            self.active = False
        elif self.active and self.queue:
            if action == "skip":
                self.queue.rotate(-1)
            elif action == "right":
                self.queue.popleft()
                self.correct += 1
                self.answered += 1
            elif action == "wrong":
                self.wrong += 1
                if self.recycle:
                    self.queue.rotate(-1)
                else:
                    self.queue.popleft()
                    self.answered += 1

    def row(self, key: int) -> tuple:
        return key, self.answered, self.correct, self.wrong, len(self.queue), self.active, self.active and not self.queue


def fold_sessions(events: DataFrame, questions: int = 10, recycle: bool = True) -> DataFrame:
    """Last state per key of (key, ts, ordinal, action). Rows stream in order through each task with one session held, so a key of any length fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, session, done = None, None, []
        names = [c.split()[0] for c in SESSION.split(", ")]
        for batch in batches:
            for key, action in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if session is None or key != now:
                    if session is not None:
                        done.append(session.row(now))
                    now, session = key, Session(questions, recycle)
                session.take(action)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done])
                done = []
        if session is not None:
            done.append(session.row(now))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done])

    rows = events.repartition("key").sortWithinPartitions("key", "ts", "ordinal")
    return rows.select(F.col("key").cast("long").alias("key"), "action").mapInArrow(run, SESSION)


_STATE = "queue array<int>, answered long, correct long, wrong long, active boolean, last long, pending array<struct<at: long, ordinal: long, action: string>>"


def stream_sessions(events: DataFrame, questions: int = 10, recycle: bool = True, delay: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """The same over a stream of (key, ts, ordinal, action), in update mode.

    Rows wait in the key's state until the watermark, ``delay`` behind the latest time seen, has passed them, and are then taken in order of (ts, ordinal): the order
    in which frames and batches bring them does not matter. Later rows no longer count. A key without rows for ``idle`` loses its state.
    """
    quiet = pd.Timedelta(idle) // pd.Timedelta(milliseconds=1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, last, pending = Session(questions, recycle), 0, []
        if state.exists:
            queue, session.answered, session.correct, session.wrong, session.active, last, held = state.get
            session.queue = deque(queue)
            pending = [tuple(p) for p in held]
        for frame in frames:
            pending += zip(frame["at"].tolist(), frame["ordinal"].tolist(), frame["action"].tolist(), strict=True)
        now = state.getCurrentWatermarkMs()
        ready = sorted(p for p in pending if p[0] // 1000 <= now)
        pending = [p for p in pending if p[0] // 1000 > now]
        for at, _, action in ready:
            session.take(action)
            last = max(last, at // 1000)
        if not ready and not pending and last + quiet <= now:
            state.remove()
            return
        state.update((list(session.queue), session.answered, session.correct, session.wrong, session.active, last, pending))
        state.setTimeoutTimestamp(max(now + 1, min(p[0] // 1000 for p in pending) if pending else last + quiet))
        if ready:
            yield pd.DataFrame([session.row(key[0])], columns=[c.split()[0] for c in SESSION.split(", ")])

    rows = events.withWatermark("ts", delay).select(F.col("key").cast("long").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("ordinal").cast("long").alias("ordinal"), "action")
    return rows.groupBy("key").applyInPandasWithState(step, SESSION, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and type; works on streams, where late rows past the delay no longer count."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
