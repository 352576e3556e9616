"""Keyed state in the order of event time, however shuffled the rows arrive: run lengths and steps from row to row."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from itertools import batched
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Rows that go to the state in one call, and in one entry of it: the entry is what costs, on the way there and back.
CHUNK, SPAN = 4096, 64

_EPOCH, _MICROSECOND = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC), datetime.timedelta(microseconds=1)


def _spans(rows: list[tuple]) -> list[tuple]:
    """Rows (at, tie, what) as entries of the state: an array for each of the three, of up to ``SPAN`` rows."""
    return [tuple(map(list, zip(*span, strict=True))) for span in batched(rows, SPAN)]


class InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then folds them by (at, tie).

    ``fold(carry, rows)`` returns the new carry and output tuples; the carry is the key's state between calls. A
    timer fires one millisecond behind a key's first waiting row, so a row is folded as soon as its millisecond
    lies wholly behind the watermark. Memory: what one key has waiting, that is the rows of its last ``late`` and
    of a batch; the bound on a batch is the source's (``maxFilesPerTrigger``).
    """

    def __init__(self, kept: str, carry: str, fold: Callable[[tuple | None, list[tuple]], tuple[tuple, list[tuple]]], names: tuple[str, ...]):
        self._kept, self._carry, self._fold, self._row = kept, carry, fold, Row(*names)

    def init(self, handle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self._kept)
        self._open = handle.getValueState("open", self._carry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, chunk = None, []
        for _, ts, tie, what in rows:
            at = (ts - _EPOCH) // _MICROSECOND
            first = at if first is None else min(first, at)
            chunk.append((at, tie, what))
            if len(chunk) == CHUNK:
                self._waiting.appendList(_spans(chunk))
                chunk = []
        if chunk:
            self._waiting.appendList(_spans(chunk))
        if first is not None:
            self._handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        bound = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for span in self._waiting.get():
            for row in zip(*span, strict=True):
                (ready if row[0] < bound else later).append(row)
        if not ready:
            return
        # By (at, tie), without a pair a row.
        ready.sort(key=itemgetter(1))
        ready.sort(key=itemgetter(0))
        carry, found = self._fold(self._open.get(), ready)
        self._open.update(carry)
        if later:
            self._waiting.put(_spans(later))
            self._handle.registerTimer(min(row[0] for row in later) // 1000 + 1)
        else:
            self._waiting.clear()
        for row in found:
            yield self._row(*key, *row)


def _runs(carry, rows):
    token, n = carry if carry is not None else (None, 0)
    done = []
    for _, _, what in rows:
        if n and what == token:
            n += 1
        else:
            if n:
                done.append((token, n))
            token, n = what, 1
    return (token, n), done


def _steps(carry, rows):
    at, what = carry if carry is not None else (None, None)
    done = []
    for now, tie, then in rows:
        done.append((now, tie, None if at is None else now - at, None if what is None or then is None else then - what))
        at, what = now, then
    return (at, what), done


def _folded(events: DataFrame, node: str, tie: str, what: Column, kind: str, late: str, carry: str, fold, out: str) -> DataFrame:
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = rows.select(node, "ts", F.coalesce(F.col(tie).cast("long"), F.lit(-1)).alias("_tie"), what.alias("_what"))
    step = InOrder(f"at array<long>, tie array<long>, what array<{kind}>", carry, fold, (node, *(field.split()[0] for field in out.split(", "))))
    return rows.groupBy(node).transformWithState(step, f"{node} {dict(events.dtypes)[node]}, {out}", "append", "EventTime")


def run_lengths(events: DataFrame, node: str = "user_id", token: str = "event_type", tie: str = "event_id", late: str = "2 hours") -> DataFrame:
    """(node, token, run_len) of every run that has ended behind the watermark, in the order of (ts, tie).

    Rows without a ts have no place and are left out; rows later than ``late`` are dropped; a null token is a token.
    """
    kind = dict(events.dtypes)[token]
    return _folded(events, node, tie, F.col(token), kind, late, f"token {kind}, n long", _runs, f"{token} {kind}, run_len long")


def steps(events: DataFrame, node: str = "user_id", value: str = "value", tie: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each row behind the watermark with the microseconds and the change of the value since the node's row before.

    Columns: node, at (microseconds since 1970), tie, gap, change. Both differences are null in a node's first row,
    the change also beside a null value.
    """
    return _folded(events, node, tie, F.col(value).cast("double"), "double", late, "at long, what double", _steps, "at long, tie long, gap long, change double")
