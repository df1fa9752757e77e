"""Notices of each user under actions ADD, UPDATE, DISMISS and REMOVE: a state machine over a stream, and the same over a finished table.

At most LIMIT notices are held, the newest first. A dismissed notice is closed and goes REMOVE_AFTER later, by the time of the actions. An action without an
id dismisses or removes all. State is bounded, so a key of any number of actions streams through its task; actions of one key follow each other, so one key
is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.session import ship

#: Notices held, and seconds between a notice's dismissal and its removal. Fixed values.
LIMIT, REMOVE_AFTER = 20, 1000
#: id, title, open, time (in microseconds) of removal or None
Notice = tuple[str, str | None, bool, int | None]

OUTPUT = "user_id long, place int, id string, title string, open boolean"
_STATE = "ids array<string>, titles array<string>, opens array<boolean>, dues array<long>"
_COLUMNS = ["at", "seq", "kind", "id", "title"]


def reduced(notices: list[Notice], at: int, kind: str, which: str | None, title: str | None) -> list[Notice]:
    """Notices after one action at time ``at``; kinds that are not known change nothing but what time does."""
    held = [n for n in notices if n[3] is None or n[3] > at]
    if kind == "ADD":
        return [(which, title, True, None), *held][:LIMIT]
    if kind == "UPDATE":
        return [(i, t if title is None else title, o, d) if i == which else (i, t, o, d) for i, t, o, d in held]
    if kind == "DISMISS":
        return [(i, t, False, at + REMOVE_AFTER * 1_000_000 if d is None else d) if which in (None, i) else (i, t, o, d) for i, t, o, d in held]
    if kind == "REMOVE":
        return [] if which is None else [n for n in held if n[0] != which]
    return held


def _none(x: object) -> object:
    return None if x is None or x is pd.NA or x != x else x


def _after(notices: list[Notice], actions: pd.DataFrame) -> list[Notice]:
    for at, kind, which, title in zip(*(actions[c].tolist() for c in ("at", "kind", "id", "title")), strict=True):
        notices = reduced(notices, int(at), kind, _none(which), _none(title))
    return notices


def _shown(user: object, notices: list[Notice]) -> pd.DataFrame:
    rows = [(user, k, i, t, o) for k, (i, t, o, _) in enumerate(notices)]
    return pd.DataFrame(rows, columns=["user_id", "place", "id", "title", "open"])


def notices(actions: DataFrame) -> DataFrame:
    """user_id, place, id, title, open: what is held after all ``actions`` (user_id, at in microseconds, seq, kind, id, title), in order of at and seq."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = None, None
        for part in parts:
            for key, group in part.groupby("user_id", sort=False):
                if held is not None and key != user:
                    yield _shown(user, held)
                    held = None
                user, held = key, _after(held or [], group)
        if held is not None:
            yield _shown(user, held)

    ship(actions.sparkSession)
    ordered = actions.filter("user_id is not null").select("user_id", *_COLUMNS).repartition("user_id").sortWithinPartitions("user_id", "at", "seq")
    return ordered.mapInPandas(run, OUTPUT)


def notice_stream(actions: DataFrame) -> DataFrame:
    """As :func:`notices`, for a stream: each trigger's actions are taken in order of at and seq, after those of triggers before; gives the users that changed.

    A user whose notices are all gone has one row with place -1.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[Notice] = [(i, t, bool(o), _none(d)) for i, t, o, d in zip(*(list(x) for x in state.get), strict=True)] if state.exists else []
        held = _after(held, pd.concat(list(parts)).sort_values(["at", "seq"]))
        state.update(tuple([n[k] for n in held] for k in range(4)))
        yield _shown(key[0], held) if held else pd.DataFrame([(key[0], -1, None, None, None)], columns=["user_id", "place", "id", "title", "open"])

    ship(actions.sparkSession)
    keyed = actions.filter("user_id is not null").select("user_id", *_COLUMNS).groupBy("user_id")
    return keyed.applyInPandasWithState(run, OUTPUT, _STATE, "update", GroupStateTimeout.NoTimeout)
