"""Streams with state of their own, kept by ``transformWithState``: an entry per fact or minute, timers in event time.

Both need the RocksDB state store (``STORE``); ``jobs.deliver`` sets it for the stream that it runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from notelake.operators.access_log import DENIALS_PER_MINUTE
from notelake.operators.memory import FOLDED, LOG, LiveFacts, _folded, fold

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

_FACT = "stamp string, text string, authority int, immutable boolean, expires string, until long, turn long"


class _Reconciler(StatefulProcessor):
    """A scope's live facts, one map entry each. A batch writes the entries that it changes; a timer removes a fact when it expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getMapState("facts", "id string", _FACT)

    def _held(self) -> list[dict]:
        names = [c.split()[0] for c in _FACT.split(", ")]
        return [{"id": k[0], **dict(zip(names, v))} for k, v in self.facts.iterator()]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # plain rows: a frame for each of many small scopes costs more than the fold
        new = sorted((r.asDict() for r in rows), key=lambda f: (f["stamp"] is None, f["stamp"] or "", f["id"] is None, f["id"] or ""))
        until = {f["id"]: f["until"] for f in new if f["until"] is not None}
        held = {f["id"]: f for f in self._held()}
        log, live = fold([{c: f[c] for c in FOLDED} for f in new], LiveFacts(sorted(held.values(), key=lambda f: f["turn"])))
        for gone in held.keys() - live.facts.keys():
            self.facts.removeKey((gone,))
        for i, f in live.facts.items():
            if i not in held or held[i]["turn"] != f["turn"]:
                end = until.get(i)
                self.facts.updateValue((i,), (f["stamp"], f["text"], f["authority"], f["immutable"], f["expires"], end, f["turn"]))
                if end is not None:
                    self.handle.registerTimer(end)
        for id_, op, target, challenges in log:
            yield Row(scope=key[0], id=id_, op=op, target=target, challenges=challenges)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for f in self._held():
            if f["until"] is not None and f["until"] <= now:
                self.facts.removeKey((f["id"],))
        yield from ()

    def close(self) -> None:
        pass


def reconcile_stream(facts: DataFrame, scope: str, late: str = "90 days") -> DataFrame:
    """(scope, id, op, target, challenges): facts reconciled as they arrive; a scope's live facts are its state.

    Facts of one batch are taken in order of stamp and id; those of a later batch that come before what they would
    replace are LATE, and those later than ``late`` behind the newest stamp are not read. An expired fact decides nothing from its
    expiry on, and its entry goes once the watermark has passed it. A scope's entries are read once a batch, but only what changes is written.
    """
    kind = dict(facts.dtypes)[scope]
    at = F.col("stamp").cast("timestamp")
    until = F.unix_millis(F.col("expires").cast("timestamp"))
    rows = _folded(facts, scope).withColumns({"__at": at, "until": until}).withWatermark("__at", late)
    made = rows.groupBy(scope).transformWithState(statefulProcessor=_Reconciler(), outputStructType=f"scope {kind}, {LOG}", outputMode="append", timeMode="EventTime")
    return made


class _DenialCap(StatefulProcessor):
    """Denials of a caller per minute: the first ``most`` pass, the others are counted, and a timer at the minute's end gives their number."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        out = []
        for minute, own in new.groupby("minute", sort=True):
            before = self.minutes.getValue((minute,))[0] if self.minutes.containsKey((minute,)) else 0
            if not before:
                self.handle.registerTimer(int(minute) + 60_000)
            self.minutes.updateValue((minute,), (before + len(own),))
            passed = own.iloc[: max(0, self.most - before)]
            out.append(pd.DataFrame({"caller": key[0], "minute": minute, "id": passed["id"].to_numpy(), "path": passed["path"].to_numpy(), "suppressed": None}))
        yield pd.concat(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        minute = expiredTimerInfo.getExpiryTimeInMs() - 60_000
        if self.minutes.containsKey((minute,)):
            n = self.minutes.getValue((minute,))[0]
            self.minutes.removeKey((minute,))
            if n > self.most:
                yield pd.DataFrame({"caller": [key[0]], "minute": [minute], "id": [None], "path": [None], "suppressed": [n - self.most]})

    def close(self) -> None:
        pass


def capped_denials(events: DataFrame, most: int = DENIALS_PER_MINUTE, late: str = "10 minutes") -> DataFrame:
    """(caller, minute, id, path, suppressed): the first ``most`` denials of a caller in a minute as they come; once the minute
    is closed by the watermark a row without an id says how many more there were, if any.

    Denials of one batch are taken in order of time and id. A denial that comes after its minute was closed is not read.
    """
    kind = dict(events.dtypes)["id"]
    at = F.col("at").cast("timestamp")
    minute = F.unix_millis(F.date_trunc("minute", at))
    denied = events.where(~F.col("allowed")).select(F.coalesce("caller", F.lit("")).alias("caller"), "id", "path", at.alias("at"), minute.alias("minute")).withWatermark("at", late)
    made = denied.groupBy("caller").transformWithStateInPandas(
        statefulProcessor=_DenialCap(most), outputStructType=f"caller string, minute long, id {kind}, path string, suppressed long", outputMode="append", timeMode="EventTime"
    )
    return made.withColumn("minute", F.timestamp_millis("minute"))
