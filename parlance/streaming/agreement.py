"""Local agreement per session: partial hypotheses become final text.

One small step function serves three runs: a batch pass over rows sorted by session, the stateful
stream operator, and tests. Committed words are kept only while they lie inside the recognizer's
buffer, and the buffer is one hypothesis; words that wait for a final are kept until one is due,
which the speaker's pauses decide.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.functions.fixed import ASCII_PUNCTUATION, BUFFER_TRIMMING_S, PAUSE_FOR_FINAL_S

EMISSION_SCHEMA = "session string, iter long, kind string, start double, end double, text string"
_STRIP = str.maketrans("", "", ASCII_PUNCTUATION)


@dataclass(frozen=True)
class Settings:
    pause: float = PAUSE_FOR_FINAL_S
    trimming: float = BUFFER_TRIMMING_S
    max_words: int = -1
    final_min_words: int | None = None
    edge: float = 0.05
    partials_per_second: float = 0
    idle: float | None = None


@dataclass
class Session:
    last_iter: int = 0
    last_committed: float = 0.0
    offset: float = 0.0
    sent_at: float | None = None
    committed: list = field(default_factory=list)
    buffer: list = field(default_factory=list)
    finals: list = field(default_factory=list)


def _same(a: str, b: str) -> bool:
    return a.lower().translate(_STRIP) == b.lower().translate(_STRIP)


def _continuation(new: list, state: Session) -> list:
    """New words after the committed ones, without a repeat of the committed tail."""
    new = [w for w in new if w[0] > state.last_committed - 0.1]
    if new and abs(new[0][0] - state.last_committed) < 1:
        texts, tail = [w[2] for w in new], [w[2] for w in state.committed]
        for n in range(1, min(len(texts), len(tail), 5) + 1):
            if tail[-n:] == texts[:n]:
                return new[n:]
    return new


def _commit(new: list, state: Session, max_words: int) -> None:
    """Move the agreed prefix of ``new`` to the committed and waiting words."""
    waiting, n = state.buffer, 0
    while n < min(len(new), len(waiting)) and (
        _same(new[n][2], waiting[n][2]) or len(waiting) - n > max_words > -1
    ):
        n += 1
    if n:
        state.last_committed = new[n - 1][1]
        state.committed = state.committed + new[:n]
        state.finals = state.finals + new[:n]
    state.buffer = new[n:]


def _trim(words: list, buffer_end: float, segment_ends: list, state: Session) -> None:
    """Forget what lies before the latest finished segment; without any speech keep two seconds."""
    if segment_ends and len(segment_ends) > 1 and state.committed:
        cuts = [e for e in segment_ends[:-1] if e <= state.last_committed]
        if not cuts:
            return
        state.offset = max(cuts)
    elif not words:
        state.offset = buffer_end - 2
    else:
        return
    state.committed = [w for w in state.committed if w[1] > state.offset]


def _final_ready(state: Session, buffer_end: float, settings: Settings) -> bool:
    if not state.finals:
        return False
    last = state.finals[-1]
    if settings.final_min_words is None:
        complete = last[2][-1:] in ASCII_PUNCTUATION and last[2] != ""
    else:
        complete = len(state.finals) > settings.final_min_words
    if not state.buffer:
        evidence = buffer_end
    elif len(state.buffer) <= 3:
        evidence = state.buffer[0][1]
    else:
        evidence = None
    return bool(complete and last[1] and evidence and last[1] + settings.pause < evidence)


def _emission(kind: str, words: list) -> tuple:
    if not words:
        return kind, None, None, ""
    return kind, words[0][0], words[-1][1], " ".join(w[2] for w in words)


def step(state: Session, hyp: dict, settings: Settings, pending: bool = False) -> list[tuple]:
    """Take one hypothesis row; returns (kind, start, end, text) to send."""
    if hyp["iter"] <= state.last_iter:
        return []
    state.last_iter = hyp["iter"]
    words, buffer_end = hyp["words"], hyp["buffer_end"]
    out = []
    if words or not hyp["eof"]:
        _commit(_continuation(words, state), state, settings.max_words)
        if state.buffer and buffer_end - state.buffer[-1][1] < settings.edge:
            state.buffer = state.buffer[:-1]
        if buffer_end - state.offset > settings.trimming:
            # Where no segment ends are given, the ends of the committed words stand in for them.
            _trim(words, buffer_end, hyp.get("segment_ends") or [w[1] for w in state.committed], state)
        if _final_ready(state, buffer_end, settings):
            out.append(_emission("final", state.finals))
            state.finals = []
            state.sent_at = None
    if hyp["eof"]:
        return [finish(state, out)]
    if not out and (state.finals or state.buffer) and _may_send(state, hyp.get("at"), settings, pending):
        out.append(_emission("partial", state.finals + state.buffer))
    return out


def finish(state: Session, out: list[tuple] = ()) -> tuple:
    """The last final of a session: all that is committed or still in the buffer, behind ``out``."""
    rest = _emission("final", state.finals + state.buffer)
    starts = [e[1] for e in [*out, rest] if e[1] is not None]
    ends = [e[2] for e in [*out, rest] if e[2] is not None]
    state.finals, state.buffer, state.committed = [], [], []
    return "final", min(starts, default=None), max(ends, default=None), "".join(e[3] for e in [*out, rest])


def _may_send(state: Session, at: float | None, settings: Settings, pending: bool) -> bool:
    if not settings.partials_per_second or at is None:
        return True
    if state.sent_at is None or not pending or at - state.sent_at > 1 / (settings.partials_per_second + 1):
        state.sent_at = at
        return True
    return False


def _rows(batch: pd.DataFrame) -> Iterator[dict]:
    for row in batch.to_dict("records"):
        row["words"] = [(w["start"], w["end"], w["word"]) for w in row["words"]]
        if row.get("segment_ends") is not None:
            row["segment_ends"] = [float(e) for e in row["segment_ends"]]
        yield row


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session", "iter", "kind", "start", "end", "text"])


def _needed(hyps: DataFrame) -> DataFrame:
    optional = [c for c in ("at", "segment_ends") if c in hyps.columns]
    return hyps.select("session", "iter", "words", "buffer_end", "eof", *optional)


def agree_batch(hyps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Emissions of stored hypotheses.

    Rows are spread by session and sorted inside the partitions; a task goes through them once
    and holds a single session's state, however long the session is.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, held = None, Session(), None
        for batch in batches:
            out = []
            for row in _rows(batch):
                if held is not None:
                    pending = held["session"] == row["session"]
                    out += [(held["session"], held["iter"], *e) for e in step(state, held, settings, pending)]
                if row["session"] != current:
                    current, state = row["session"], Session()
                held = row
            yield _frame(out)
        if held is not None:
            yield _frame([(held["session"], held["iter"], *e) for e in step(state, held, settings)])

    spread = _needed(hyps).repartition("session").sortWithinPartitions("session", "iter")
    return spread.mapInPandas(run, EMISSION_SCHEMA)


class Agreement(StatefulProcessor):
    """The step function with one JSON value of state for each session.

    A session ends with its ``eof`` row, or, where ``idle`` is set, as many seconds after its last
    row: a timer then sends what is left as a final. Its state goes with it.
    """

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("session", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = Session(**json.loads(self.saved.get()[0])) if self.saved.exists() else Session()
        steps = sorted((row for batch in rows for row in _rows(batch)), key=lambda r: r["iter"])
        out = []
        for i, row in enumerate(steps):
            out += [(key[0], row["iter"], *e) for e in step(state, row, self.settings, i + 1 < len(steps))]
        if self.settings.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if any(row["eof"] for row in steps):
            self.saved.clear()
        else:
            self.saved.update((json.dumps(state.__dict__),))
            if self.settings.idle is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.settings.idle * 1000))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.saved.exists():
            state = Session(**json.loads(self.saved.get()[0]))
            self.saved.clear()
            if state.finals or state.buffer:
                yield _frame([(key[0], state.last_iter, *finish(state))])

    def close(self) -> None:
        pass


def agree_stream(hyps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Emissions of a stream of hypotheses, append mode; needs the RocksDB state store."""
    mode = "None" if settings.idle is None else "ProcessingTime"
    return _needed(hyps).groupBy("session").transformWithStateInPandas(
        Agreement(settings), outputStructType=EMISSION_SCHEMA, outputMode="Append", timeMode=mode
    )
