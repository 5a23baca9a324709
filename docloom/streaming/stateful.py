"""State handlers of streams that keep lists and maps per key, with event-time timers.

They run under ``transformWithStateInPandas``, which needs the RocksDB state store. Rows behind the watermark are dropped and counted by Spark
(``numRowsDroppedByWatermark``), so once the watermark has passed a time nothing older can arrive: the handlers
wait for that moment where order matters, and a timer wakes them. State leaves by timers too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom import rules


def wake_at(handle: StatefulProcessorHandle, ms: int | None) -> None:
    """Keep one timer a key."""
    present = [int(t) for t in handle.listTimers()]
    for t in present:
        if t != ms:
            handle.deleteTimer(t)
    if ms is not None and ms not in present:
        handle.registerTimer(ms)


#: Keys are dealt into so many groups: a call for each of many small keys costs far more than its rows.
PARTS = 512


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as one value of state."""
    data, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema) as out:
        out.write_table(data)
    return sink.getvalue().to_pybytes()


def unpacked(values: list[bytes], columns: list[str]) -> pd.DataFrame:
    frames = [pa.ipc.open_stream(v).read_pandas() for v in values]
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c: [] for c in columns})


def runs(key: pd.Series, *order: pd.Series) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Positions sorted by key and ``order``, and the range of each key among them; nulls are one key."""
    code = pd.factorize(key, use_na_sentinel=False)[0]
    at = np.lexsort((*reversed([o.to_numpy() for o in order]), code))
    cuts = np.flatnonzero(np.diff(code[at])) + 1
    return at, list(zip([0, *cuts], [*cuts, len(at)])) if len(at) else []


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


FOLD = "session_id string, reply string, failure string, next_index bigint, tool_calls bigint, ended boolean, skipped bigint"


class SessionFold(StatefulProcessor):
    """Folds the events of a session in order of seq.

    Events that follow on each other are folded at once. One behind a gap waits in a list until the watermark has
    passed its time: what is missing then will not come. Calls are a map by id. At the first boundary what waits is dropped; of the session a
    few numbers stay, so that later events are known to be late, until nothing was heard for ``keep_ms``.

    A key is one of ``PARTS`` groups of sessions with one timer. Its numbers and what waits are read together, and the list, a row a session, is written at
    once, as each access is a round trip to the JVM; of the numbers only those that changed are written.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getMapState(
            "progress", "session_id string", "reply string, failure string, next bigint, calls bigint, skipped bigint, last_ms bigint, ended boolean"
        )
        self.waiting = handle.getListState("waiting", "session_id string, events string")
        self.calls = handle.getMapState("calls", "session_id string, call_id string", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict = {}
        for part in rows:
            for name, *event in part[["session_id", "seq", "us", "type", "message", "so_far", "call_id"]].itertuples(index=False):
                fresh.setdefault(_text(name), []).append(tuple(event))
        yield from self._fold_all(fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold_all({}, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _fold_all(self, fresh: dict, passed: int) -> Iterator[pd.DataFrame]:
        known = {name: tuple(row) for (name,), row in self.progress.iterator()}
        waiting: dict = {}
        for name, events in self.waiting.get():
            waiting[name] = {event[0]: tuple(event) for event in json.loads(events)}
        calls: dict = {}
        for name, call in self.calls.keys():
            calls.setdefault(name, set()).add(call)
        out, wakes, moved = [], [], False
        for name in [*fresh, *(n for n in known if n not in fresh)]:
            held = waiting.get(name, {})
            wake = self._wake(held, known[name][5]) if name not in fresh else 0
            if wake <= passed:
                row, left, wake = self._fold(name, fresh.get(name, []), known.get(name), held, calls.get(name, set()), passed)
                out += [row] if row else []
                moved = moved or left.keys() != held.keys()
                waiting[name] = left
            wakes += [wake] if wake is not None else []
        wake_at(self.handle, max(min(wakes), passed + 1) if wakes else None)
        if moved:
            rows = [(name, json.dumps([held[seq] for seq in sorted(held)])) for name, held in waiting.items() if held]
            if rows:
                self.waiting.put(rows)
            else:
                self.waiting.clear()
        if out:
            columns = ["session_id", "reply", "failure", "next_index", "tool_calls", "ended", "skipped"]
            yield pd.DataFrame(out, columns=columns).astype({"next_index": "Int64"})

    def _wake(self, held: dict, last_ms: int) -> int:
        """When a session has something to do without new events."""
        return held[min(held)][1] // 1000 + 1 if held else last_ms + self.keep_ms

    def _fold(self, name, fresh: list[tuple], known: tuple | None, kept: dict, calls: set, passed: int) -> tuple:
        """The session's row if it changed, what waits, and the next time to wake unless nothing of the session is left."""
        reply, failure, next_seq, n_calls, skipped, last_ms, ended = known or (None, None, None, 0, 0, 0, False)
        last_ms = max([last_ms, *(r[1] // 1000 for r in fresh)])
        before = (reply, failure, next_seq, n_calls, skipped, ended)
        held: dict[int, tuple] = {}
        if not ended:
            for row in [*kept.values(), *fresh]:
                if next_seq is not None and row[0] < next_seq:
                    skipped += 1
                else:
                    held.setdefault(row[0], row)
        called: dict[str, int] = {}
        for seq in sorted(held):
            _, us, kind, message, so_far, call = held[seq]
            if not (seq == (next_seq or 0) or us <= passed * 1000):
                break
            del held[seq]
            stale = next_seq is None and seq > 0 and kind == "session.waiting"
            next_seq = seq + 1
            if kind == "message.completed" and _text(message) is not None:
                reply = message
            elif kind == "message.appended" and _text(so_far) is not None:
                reply = so_far
            elif kind in ("actions.requested", "action.result") and _text(call) is not None:
                if call not in calls and call not in called:
                    called[call] = seq
                    n_calls += 1
            if kind == "session.failed":
                failure = message if _text(message) is not None else "session failed"
            if kind in rules.TURN_BOUNDARIES and not stale:
                ended, held = True, {}
                break
        gone = not held and last_ms + self.keep_ms <= passed
        if ended or gone:
            for call in calls:
                self.calls.removeKey((name, call))
        else:
            for call, seq in called.items():
                self.calls.updateValue((name, call), (seq,))
        now = (reply, failure, next_seq, n_calls, skipped, last_ms, ended)
        if not gone:
            if now != known:
                self.progress.updateValue((name,), now)
        elif known is not None:
            self.progress.removeKey((name,))
        changed = (reply, failure, next_seq, n_calls, skipped, ended) != before
        row = (name, reply, failure, next_seq, n_calls, ended, skipped) if changed else None
        return row, held, None if gone else self._wake(held, last_ms)


USAGE = "attempt_id bigint, scope string, attempts bigint, oldest_us bigint"


class TrailingUsage(StatefulProcessor):
    """For every attempt of a name, how many of its attempts lie in each trailing window, itself included, and the oldest of them.

    A key is one kind and one of ``PARTS`` groups of names. Attempts wait until the watermark has passed them and are then counted together, so order
    of arrival does not matter. The state is the waiting attempts, a value for each batch, and the times within the longest window; it goes when the last of
    them has left that.
    """

    def __init__(self, windows: dict[str, list[tuple[str, int]]]):
        self.windows = windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([part[["name", "us", "attempt_id"]] for part in rows], ignore_index=True)
        self.waiting.appendValue((packed(fresh),))
        timers = [int(t) for t in self.handle.listTimers()]
        wake_at(self.handle, min([int(fresh["us"].min()) // 1000 + 1, *timers]))  # a timer that is due fires after the rows
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = unpacked([v for (v,) in self.waiting.get()], ["name", "us", "attempt_id"])
        ripe = waiting["us"] <= passed * 1000
        left, waiting = waiting[~ripe], waiting[ripe]
        known = self.times.get()
        known = unpacked([known[0]] if known else [], ["name", "us"])
        every = pd.concat([f for f in (known, waiting) if len(f)], ignore_index=True) if len(known) + len(waiting) else known
        longest = max(width for _, width in self.windows[key[0]])
        keep = every.loc[every["us"] >= passed * 1000 - longest, ["name", "us"]]
        if len(keep):
            self.times.update((packed(keep),))
        elif len(known):
            self.times.clear()
        if len(left):
            self.waiting.put([(packed(left),)])
        elif len(waiting):
            self.waiting.clear()
        wakes = [int(left["us"].min()) // 1000 + 1] if len(left) else []
        wakes += [(int(keep["us"].max()) + longest) // 1000 + 1] if len(keep) else []
        wake_at(self.handle, max(min(wakes), passed + 1) if wakes else None)
        if len(waiting):
            yield from self._counted(key[0], every, len(known))

    def _counted(self, kind: str, every: pd.DataFrame, n_known: int) -> Iterator[pd.DataFrame]:
        """Rows of ``every`` from ``n_known`` on, counted among those of their name."""
        at, names = runs(every["name"], every["us"])
        us, fresh = every["us"].to_numpy(np.int64)[at], at >= n_known
        ids = every["attempt_id"].to_numpy()[at[fresh]].astype(np.int64)
        for scope, width in self.windows[kind]:
            start, upto = np.empty(len(us), np.int64), np.empty(len(us), np.int64)
            for a, b in names:
                start[a:b] = a + np.searchsorted(us[a:b], us[a:b] - width, "left")
                upto[a:b] = a + np.searchsorted(us[a:b], us[a:b], "right")
            yield pd.DataFrame({"attempt_id": ids, "scope": scope, "attempts": (upto - start)[fresh], "oldest_us": us[start[fresh]]})

    def close(self) -> None:
        pass
