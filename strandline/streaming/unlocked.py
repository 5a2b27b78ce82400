"""What each user has unlocked, as a stream with state: saved lists, toggles, and a default where there is no valid list.

Spark keeps one list per user in its state store, and the checkpoint carries it over a restart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed value: what is unlocked where nothing valid was saved.
DEFAULT = ("1",)
UNLOCKED = "user STRING, unlocked ARRAY<STRING>, n_events LONG"
#: The state store that such state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def saved(body: str | None) -> list[str]:
    """The list that a saved text holds; the default if it holds none."""
    try:
        found = json.loads(body or "")
    except ValueError:
        found = None
    return [x if isinstance(x, str) else json.dumps(x) for x in found] if isinstance(found, list) else list(DEFAULT)


class Unlocked(StatefulProcessor):
    """Events of a user in the order of ``at``, ties by action and body: save replaces the list by the one in ``body``, toggle adds or takes away the id in it, any other
    action only asks. A null body saves the default and toggles nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("unlocked", "ids ARRAY<STRING>, n LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        ids, n = (list(now[0]), now[1]) if now else (list(DEFAULT), 0)
        events = pd.concat(list(rows)).sort_values(["at", "action", "body"])
        for action, body in zip(events["action"], events["body"]):
            known = body is not None and body == body
            if action == "save":
                ids = saved(body if known else None)
            elif action == "toggle" and known:
                ids = [x for x in ids if x != body] if body in ids else [*ids, body]
        self.state.update((ids, n + len(events)))
        yield pd.DataFrame({"user": [key[0]], "unlocked": [ids], "n_events": [n + len(events)]})

    def close(self) -> None:
        pass


def unlocked(events: DataFrame) -> DataFrame:
    """user, unlocked, n_events after each batch of events (user, at, action, body), for the users in the batch."""
    rows = events.select("user", "at", "action", "body")
    return rows.groupBy("user").transformWithStateInPandas(statefulProcessor=Unlocked(), outputStructType=UNLOCKED, outputMode="Update", timeMode="None")
