"""Access-log analytics: caps, bursts, retention and browsing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest text field kept; denials a caller may log per minute.
CLIP, DENIALS_PER_MINUTE = 512, 120


def ingest(events: DataFrame) -> DataFrame:
    """Denials, and reads of what is restricted, with long fields clipped."""
    kept = events.where(~F.col("allowed") | F.col("restricted"))
    texts = [c for c, t in kept.dtypes if t == "string"]
    return kept.withColumns({c: F.left(c, F.lit(CLIP)) for c in texts})


def cap_denials(events: DataFrame, most: int = DENIALS_PER_MINUTE) -> DataFrame:
    """(caller, minute, kept, suppressed) of denials per caller and minute."""
    denied = events.where(~F.col("allowed")).groupBy("caller", F.window("at", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return denied.select(
        "caller", F.col("w.start").cast("timestamp_ntz").alias("minute"), F.least("n", F.lit(most)).cast("long").alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("suppressed")
    )


#: Windows that a slice of a caller's time is long; documents named with a burst.
WINDOWS_PER_SLICE, SAMPLE_DOCS = 12, 8


def _bursts(events: DataFrame, seconds: int, least: int, breadth: bool) -> DataFrame:
    """(caller, n, first, last, documents): per caller the first of the windows with the highest count, from ``least`` on.

    A caller's time is cut into slices of ``WINDOWS_PER_SLICE`` windows. A slice also holds the events of one window after it, so each
    window lies whole in the slice that it starts in, and a busy caller spreads over as many tasks as its time has slices. Within a
    slice two pointers move over the events once.
    """
    width = seconds * 1_000_000
    span = width * WINDOWS_PER_SLICE
    at = F.unix_micros(F.col("at").cast("timestamp"))
    rows = events.where(F.col("at").isNotNull()).select("caller", "id", "path", "allowed", at.alias("t"))
    slice_ = F.floor(F.col("t") / span)
    both = F.array(slice_, F.when(F.col("t") - slice_ * span <= width, slice_ - 1))
    sliced = rows.withColumn("slice", F.explode(F.array_compact(both)))

    def widest(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["t", "id"], kind="stable")
        t, path = g["t"].to_numpy(), g["path"].tolist()
        counted = (g["allowed"] if breadth else ~g["allowed"]).to_numpy(dtype=bool)
        own = t // span == g["slice"].iloc[0]
        held: dict = {}
        best, at, n, last, j = 0, -1, 0, -1, 0
        for i in range(len(t)):
            while j < len(t) and t[j] - t[i] <= width:
                if counted[j]:
                    held[path[j]] = held.get(path[j], 0) + 1
                    n, last = n + 1, j
                j += 1
            have = len(held) if breadth else n
            if own[i] and have > best and (breadth or counted[i]):
                best, at, end = have, i, last
            if counted[i]:
                n -= 1
                held[path[i]] -= 1
                if not held[path[i]]:
                    del held[path[i]]
        if at < 0 or best < least:
            return pd.DataFrame([], columns=["caller", "n", "t", "u", "documents"])
        named = [path[k] for k in range(at, end + 1) if counted[k]]
        named = list(dict.fromkeys(named)) if breadth else named
        return pd.DataFrame([(group["caller"].iloc[0], best, t[at], t[end], named[:SAMPLE_DOCS])], columns=["caller", "n", "t", "u", "documents"])

    each = sliced.groupBy("caller", "slice").applyInPandas(widest, "caller string, n long, t long, u long, documents array<string>")
    best = each.groupBy("caller").agg(F.max_by(F.struct("n", "t", "u", "documents"), F.struct("n", -F.col("t"))).alias("b"))
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return best.select("caller", "b.n", moment("b.t").alias("first"), moment("b.u").alias("last"), "b.documents")


def breadth_bursts(events: DataFrame, seconds: int = 300, least: int = 15) -> DataFrame:
    """(caller, n, first, last, documents): the window, starting at an event, with most distinct documents read per caller; the first ones are named.

    Windows have to reach ``least`` documents; of equal ones the first counts.
    """
    return _bursts(events, seconds, least, True)


def denial_bursts(events: DataFrame, seconds: int = 300, least: int = 5) -> DataFrame:
    """(caller, n, first, last, documents) of the window with most denials per caller, starting at a denial; its first ones are named."""
    return _bursts(events, seconds, least, False)


def anomalies(events: DataFrame, since, seconds: int = 300, breadth: int = 15, denials: int = 5) -> DataFrame:
    """Both kinds of burst since an instant."""
    recent = events.where(F.col("at") >= since)
    a = breadth_bursts(recent, seconds, breadth).withColumn("kind", F.lit("breadth"))
    return a.unionByName(denial_bursts(recent, seconds, denials).withColumn("kind", F.lit("denied")))


def prune(events: DataFrame, now, days: int = 90) -> DataFrame:
    return events.where(F.col("at") >= now - F.make_dt_interval(F.lit(days)))


def browse(events: DataFrame, path: str | None = None, caller: str | None = None, denied_only: bool = False, n: int = 200) -> DataFrame:
    rows = events
    if path:
        rows = rows.where(F.contains("path", F.lit(path)))
    if caller:
        rows = rows.where(F.col("caller") == caller)
    if denied_only:
        rows = rows.where(~F.col("allowed"))
    return rows.orderBy(F.desc("at"), F.desc("id")).limit(n)
