"""Stateful streams over arriving messages: put in order, silence filled in, gathered into chunks.

All three keep a bounded state for each session and release rows by timers, so what they send does
not depend on how the stream is cut into micro-batches.

* ``in_order`` waits for missing messages in a map by sequence number. Rows leave as soon as all
  numbers before theirs have left; a gap is given up once the watermark has passed the first row
  behind it, and later rows of a gap that was given up are dropped, as are repeats.
* ``silence_filled`` sends a row of silence at each timeout after the last arrival. In event time a
  timer of the watermark does so, in processing time the clock; an arrival sends what is due before it.
* ``gathered`` holds packets in a list until they are long enough, sends them as one chunk and starts
  with an empty list.

``silence_filled`` and ``gathered`` take rows of a session in order; ``in_order`` gives that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.functions.fixed import MIN_CHUNK_S, SILENCE_TIMEOUT_FACTOR

ORDERED = "session string, place long, seq long, ts timestamp, payload string"
FILLED = "session string, event_id long, at_s double"
CHUNKS = "session string, chunk long, first_id long, last_id long, packets long, seconds double"


def _rows(rows: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for batch in rows:
        yield from batch.to_dict("records")


class _Stateful(StatefulProcessor):
    """What the processors share: named value states, and one timer a session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def remind(self, at_ms: float | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_ms is not None:
            self.handle.registerTimer(int(at_ms))

    def close(self) -> None:
        pass


class InOrder(_Stateful):
    def __init__(self, first: int):
        self.first = first

    def open(self) -> None:
        self.next = self.handle.getValueState("next", "seq long, place long")
        self.held = self.handle.getMapState("held", "seq long", "ts long, payload string")

    def _held(self) -> dict:
        """The waiting rows by seq, read from the state once for a call."""
        return {k[0]: tuple(value) for k, value in self.held.iterator()}

    def _release(self, key, held: dict, known: set, seq: int, place: int) -> pd.DataFrame:
        """Rows that follow without a gap; a timer stays for the first one behind a gap.

        ``known`` are the rows that the state holds: only what changed is written back.
        """
        out = []
        while seq in held:
            ts, payload = held.pop(seq)
            out.append((key[0], place, seq, pd.Timestamp(ts, unit="us"), payload))
            if seq in known:
                self.held.removeKey((seq,))
            seq, place = seq + 1, place + 1
        for waiting in held.keys() - known:
            self.held.updateValue((waiting,), held[waiting])
        self.next.update((seq, place))
        # one millisecond on, so that a row at the watermark itself has had its time
        self.remind(min(ts for ts, _ in held.values()) // 1000 + 1 if held else None)
        return pd.DataFrame(out, columns=["session", "place", "seq", "ts", "payload"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, place = self.next.get() if self.next.exists() else (self.first, 0)
        held = self._held()
        known = set(held)
        for row in _rows(rows):
            # beside a missing number pandas has floats, which the state does not take
            if not isinstance(row["seq"], float) and row["seq"] >= seq and row["seq"] not in held:
                held[row["seq"]] = (int(row["ts"].value // 1000), row["payload"])
        yield self._release(key, held, known, seq, place)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        over = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        while True:
            late = [seq for seq, (ts, _) in held.items() if ts // 1000 < over]
            if not late:
                break
            # all that was missing before the last overdue row is given up at once
            _, place = self.next.get()
            yield self._release(key, held, set(held), min(seq for seq in held if seq <= max(late)), place)


def in_order(messages: DataFrame, lateness: str, first: int = 0) -> DataFrame:
    """(session, place, seq, ts, payload) of a stream: every session's rows by seq, place counts from 0.

    ``seq`` goes up by one from ``first``. State is bounded by the rows that arrive within ``lateness``.
    """
    rows = messages.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "ts", F.col("payload").cast("string").alias("payload"))
    return rows.withWatermark("ts", lateness).groupBy("session").transformWithStateInPandas(
        InOrder(first), outputStructType=ORDERED, outputMode="Append", timeMode="EventTime"
    )


class Silence(_Stateful):
    """State: time of the last row, silence rows sent since, whether the session ended, when the row came (ms)."""

    def __init__(self, wait: float, clock: bool):
        self.wait, self.clock = wait, clock

    def open(self) -> None:
        self.last = self.handle.getValueState("last", "at_s double, sent long, ended boolean, came long")

    def _due(self, key, at: float, sent: int, before: float) -> tuple[list[tuple], int]:
        """Silence at each timeout after ``at`` and before ``before`` that was not sent yet."""
        n = max(sent, math.ceil((before - at) / self.wait) - 1)
        return [(key[0], None, at + i * self.wait) for i in range(sent + 1, n + 1)], n

    def _keep(self, at: float, sent: int, ended: bool, came: int) -> None:
        self.last.update((at, sent, ended, came))
        self.remind(None if ended else came + (sent + 1) * self.wait * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, sent, ended, came = self.last.get() if self.last.exists() else (None, 0, False, 0)
        out = []
        for row in sorted(_rows(rows), key=lambda r: (r["at_s"], r["event_id"])):
            if at is not None and not ended:
                due, _ = self._due(key, at, sent, row["at_s"])
                out += due
            out.append((key[0], row["event_id"], row["at_s"]))
            at, sent, ended, came = row["at_s"], 0, bool(row["eof"]), int(row["ts"].value // 1_000_000)
        self._keep(at, sent, ended, timerValues.getCurrentProcessingTimeInMs() if self.clock else came)
        yield pd.DataFrame(out, columns=["session", "event_id", "at_s"]).astype({"event_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, sent, ended, came = self.last.get()
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock else timerValues.getCurrentWatermarkInMs()
        out, n = self._due(key, at, sent, at + (now - came) / 1000)
        self._keep(at, n, ended, came)
        yield pd.DataFrame(out, columns=["session", "event_id", "at_s"]).astype({"event_id": "Int64"})


def silence_filled(packets: DataFrame, length: float, factor: float = SILENCE_TIMEOUT_FACTOR, lateness: str | None = None) -> DataFrame:
    """The stream form of ``live.fill_silence``: (session, event_id, at_s), silence without an event_id.

    ``packets`` is (session, event_id, at_s, ts, eof); at_s and ts are one time, as a number and as a
    timestamp. After ``eof`` no silence follows. With ``lateness`` time is that of the packets, else
    that of the clock, which also sends silence while nothing arrives at all.
    """
    rows = packets.select(
        F.col("session").cast("string").alias("session"), F.col("event_id").cast("long").alias("event_id"), F.col("at_s").cast("double").alias("at_s"), "ts", "eof"
    )
    rows = rows if lateness is None else rows.withWatermark("ts", lateness)
    return rows.groupBy("session").transformWithStateInPandas(
        Silence(length * factor, lateness is None), outputStructType=FILLED, outputMode="Append",
        timeMode="ProcessingTime" if lateness is None else "EventTime",
    )


class Gathered(_Stateful):
    def __init__(self, minimum: float):
        self.minimum = minimum

    def open(self) -> None:
        self.waiting = self.handle.getListState("waiting", "event_id long, seconds double")
        self.sent = self.handle.getValueState("sent", "chunks long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(v) for v in self.waiting.get()] if self.waiting.exists() else []
        chunk = self.sent.get()[0] if self.sent.exists() else 0
        out = []
        for row in sorted(_rows(rows), key=lambda r: r["seq"]):
            held.append((row["event_id"], row["seconds"]))
            total = math.fsum(s for _, s in held)
            if total >= self.minimum or row["eof"]:
                out.append((key[0], chunk, held[0][0], held[-1][0], len(held), total))
                held, chunk = [], chunk + 1
        if held:
            self.waiting.put(held)
        else:
            self.waiting.clear()
        self.sent.update((chunk,))
        yield pd.DataFrame(out, columns=["session", "chunk", "first_id", "last_id", "packets", "seconds"])


def gathered(packets: DataFrame, minimum: float = MIN_CHUNK_S) -> DataFrame:
    """Chunks of at least ``minimum`` seconds of a stream (session, seq, event_id, seconds, eof); the last may be shorter."""
    rows = packets.select(
        F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), F.col("event_id").cast("long").alias("event_id"),
        F.col("seconds").cast("double").alias("seconds"), "eof",
    )
    return rows.groupBy("session").transformWithStateInPandas(Gathered(minimum), outputStructType=CHUNKS, outputMode="Append", timeMode="None")
