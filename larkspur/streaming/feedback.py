"""Keyed state over the feedback journal and over hits: what each event changes, as it comes.

A processor's state of a user is read and written by the key of what an event touches, never as a whole, so its memory
follows one micro-batch, not a user's history. Rows of a micro-batch are taken in order of ``sequence``; a later batch may
bring rows of any sequence to the feedback state, while weights and throttling take rows in the order of the batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SETS = {"like": ("preference", 1), "dislike": ("preference", -1), "known": ("known", True), "new": ("known", False)}


def state_of(events: list[tuple[int, str]]) -> dict:
    """preference and known after (sequence, action) in order; clear resets both."""
    now: dict = {}
    for _, action in sorted(events):
        if action == "clear":
            now = {}
        elif action in SETS:
            now[SETS[action][0]] = SETS[action][1]
    return now


class _Cached:
    """A map state, with each key read once and written once in a micro-batch. Values are strings."""

    def __init__(self, state):
        self.state, self.now, self.changed = state, {}, set()

    def get(self, key: int) -> str | None:
        if key not in self.now:
            self.now[key] = self.state.getValue((key,))[0] if self.state.containsKey((key,)) else None
        return self.now[key]

    def put(self, key: int, value: str | None) -> None:
        self.now[key] = value
        self.changed.add(key)

    def save(self) -> None:
        for key in self.changed:
            if self.now[key] is not None:
                self.state.updateValue((key,), (self.now[key],))
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))


class FeedbackState(StatefulProcessor):
    """Per user: ``items`` holds the active events of each item, ``events`` the item of each sequence, ``undone`` the
    sequences that an undo has named, whether or not their event has come yet. A changed item gives a row whose version
    is larger than any before."""

    OUT = "user long, item long, preference int, known boolean, active boolean, version long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item long", "events string")
        self.events = handle.getMapState("events", "sequence long", "item string")
        self.undone = handle.getMapState("undone", "sequence long", "by string")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items, events, undone, touched = _Cached(self.items), _Cached(self.events), _Cached(self.undone), {}
        for part in rows:
            for sequence, action, item, target in zip(part["sequence"].tolist(), part["action"], part["item"].tolist(), part["target"].tolist()):
                if action == "undo":
                    if target == target:  # an undo without a target undoes nothing
                        undone.put(int(target), "undo")
                        of = events.get(int(target))
                        if of is not None:
                            self._change(items, int(of), touched, drop=int(target))
                    continue
                item = int(item)  # pandas makes a column with nulls one of floats
                events.put(sequence, str(item))
                if undone.get(sequence) is None:
                    self._change(items, item, touched, add=(sequence, action))
        version = (self.version.get() or (0,))[0] if self.version.exists() else 0
        out = []
        for item in touched:
            now = state_of(self._read(items.get(item)))
            version += 1
            out.append((key[0], item, now.get("preference", 0), now.get("known", False), bool(now), version))
        self.version.update((version,))
        for x in (items, events, undone):
            x.save()
        yield pd.DataFrame(out, columns=["user", "item", "preference", "known", "active", "version"])

    @staticmethod
    def _read(text: str | None) -> list[tuple[int, str]]:
        return [(int(s), a) for s, a in (x.split(":") for x in (text or "").split(",") if x)]

    def _change(self, items: _Cached, item: int, touched: dict, add=None, drop=None) -> None:
        kept = [e for e in self._read(items.get(item)) if e[0] != drop and (add is None or e[0] != add[0])] + ([add] if add else [])
        items.put(item, ",".join(f"{s}:{a}" for s, a in sorted(kept)) or None)
        touched[item] = True

    def close(self) -> None:
        pass


def feedback_changes(journal: DataFrame) -> DataFrame:
    """Stream of (user, sequence, action, item, target) -> a row for each item whose state a micro-batch touched."""
    return journal.groupBy("user").transformWithStateInPandas(FeedbackState(), FeedbackState.OUT, "Append", "None")


def current(changes: DataFrame) -> DataFrame:
    """The last state of each (user, item) among appended changes; items that no event marks are absent."""
    last = changes.groupBy("user", "item").agg(F.max_by(F.struct("preference", "known", "active"), "version").alias("s"))
    return last.where("s.active").select("user", "item", "s.preference", "s.known")


class OnlineWeights(StatefulProcessor):
    """Per user one value: how many rows were taken and theta, after theta += eta * (y - sigmoid(theta . x)) * x for each."""

    OUT = "user long, taken long, theta array<double>"

    def __init__(self, dims: int, eta: float = 0.1):
        self.dims, self.eta = dims, eta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("weights", "taken long, theta array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken, theta = self.state.get() if self.state.exists() else (0, [0.0] * self.dims)
        theta = list(theta)
        for _, x, y in sorted(row for part in rows for row in zip(part["sequence"].tolist(), map(list, part["x"]), part["y"].tolist())):
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(theta, x))))
            theta = [a + self.eta * (y - p) * b for a, b in zip(theta, x)]
            taken += 1
        self.state.update((taken, theta))
        yield pd.DataFrame({"user": [key[0]], "taken": [taken], "theta": [theta]})

    def close(self) -> None:
        pass


def weight_changes(rows: DataFrame, dims: int, eta: float = 0.1) -> DataFrame:
    """Stream of (user, sequence, x, y) -> a user's weights after each micro-batch that has rows of them."""
    return rows.groupBy("user").transformWithStateInPandas(OnlineWeights(dims, eta), OnlineWeights.OUT, "Append", "None")


def last_weights(changes: DataFrame) -> DataFrame:
    return changes.groupBy("user").agg(F.max_by("theta", "taken").alias("theta"))


class Throttle(StatefulProcessor):
    """Per user one value: when the window opened and how many hits it has had."""

    OUT = "user long, event_id long, allow boolean, reset long"

    def __init__(self, allowed: int = 3, window: int = 3600):
        self.allowed, self.window = allowed, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, used = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for ts, event in sorted(row for part in rows for row in zip(part["ts"].tolist(), part["event_id"].tolist())):
            if start is None or ts - start >= self.window:
                start, used = ts, 0
            used += 1
            out.append((key[0], event, used <= self.allowed, start + self.window - ts))
        self.state.update((start, used))
        yield pd.DataFrame(out, columns=["user", "event_id", "allow", "reset"])

    def close(self) -> None:
        pass


def throttled(hits: DataFrame, allowed: int = 3, window: int = 3600) -> DataFrame:
    """Stream of (user, event_id, ts) -> allow and seconds to reset of each hit, once."""
    return hits.groupBy("user").transformWithStateInPandas(Throttle(allowed, window), Throttle.OUT, "Append", "None")

