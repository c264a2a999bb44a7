"""Session logs as batch tables and as streams: state, latest rows per key, activity in windows of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session string, state string, hints long, revealed boolean, illegal long"
STATE = "state string, hints long, revealed boolean, illegal long, last long"


def fold(log: DataFrame) -> DataFrame:
    """Per session of (session, seq, event): state, hints, revealed, illegal.

    Events are start, hint, reveal, finish and abandon. The first start opens a session and the first end after it
    closes it; hints count between these, the first reveal wins. Every other event is illegal and changes nothing.
    Null sessions, sequence numbers and events are ignored. Aggregates only: no session is gathered into one row.
    """
    rows = log.where("session is not null and seq is not null and event is not null").select("session", "seq", "event")
    w = W.partitionBy("session")
    rows = rows.withColumn("_from", F.min(F.when(F.col("event") == "start", F.col("seq"))).over(w))
    ends = F.col("event").isin("finish", "abandon")
    rows = rows.withColumn("_to", F.min(F.when(ends & (F.col("seq") > F.col("_from")), F.col("seq"))).over(w))
    inside = (F.col("seq") > F.col("_from")) & (F.col("_to").isNull() | (F.col("seq") < F.col("_to")))
    rows = rows.withColumn("_reveal", F.min(F.when(inside & (F.col("event") == "reveal"), F.col("seq"))).over(w))
    legal = ((F.col("event") == "start") & (F.col("seq") == F.col("_from"))) | (ends & (F.col("seq") == F.col("_to"))) | (inside & (F.col("event") == "hint")) | (inside & (F.col("event") == "reveal") & (F.col("seq") == F.col("_reveal")))
    end = F.max(F.when(F.col("seq") == F.col("_to"), F.col("event")))
    state = F.when(F.max("_from").isNull(), "none").when(end == "finish", "finished").when(end == "abandon", "abandoned").otherwise("open")
    return rows.groupBy("session").agg(state.alias("state"), F.count_if(inside & (F.col("event") == "hint")).alias("hints"), F.max("_reveal").isNotNull().alias("revealed"), F.count_if(~F.coalesce(legal, F.lit(False))).alias("illegal"))


def _step(state: tuple, event: str) -> tuple:
    kind, hints, revealed, illegal, last = state
    if event == "start" and kind == "none":
        return "open", hints, revealed, illegal, last
    if kind == "open" and event == "hint":
        return kind, hints + 1, revealed, illegal, last
    if kind == "open" and event == "reveal" and not revealed:
        return kind, hints, True, illegal, last
    if kind == "open" and event in ("finish", "abandon"):
        return {"finish": "finished", "abandon": "abandoned"}[event], hints, revealed, illegal, last
    return kind, hints, revealed, illegal + 1, last


def fold_stream(log: DataFrame) -> DataFrame:
    """fold() of a stream, in update mode: each batch gives the sessions that changed, as they now stand.

    A session's state is five values, so memory does not grow with its events. Events of one batch are taken by seq; one
    that comes in a later batch than an event of a higher seq counts as illegal.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("none", 0, False, 0, -(2**63))
        rows = pd.concat([b[["seq", "event"]] for b in batches]).sort_values("seq", kind="stable")
        for seq, event in zip(rows["seq"].tolist(), rows["event"].tolist(), strict=True):
            late = seq < now[4]
            now = (*now[:3], now[3] + 1, now[4]) if late else (*_step(tuple(now), event)[:4], seq)
        state.update(tuple(now))
        yield pd.DataFrame([(key[0], *now[:4])], columns=["session", "state", "hints", "revealed", "illegal"])

    rows = log.where("session is not null and seq is not null and event is not null").select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "event")
    return rows.groupBy("session").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, of a batch table or, in complete or update mode, of a stream."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("r")).select(key, "r.*")


def activity(events: DataFrame, time: str, size: str = "1 day", delay: str = "2 days", *by: str) -> DataFrame:
    """Events per window of event time; a stream drops what comes later than ``delay``, a batch table drops nothing."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    return timed.groupBy(F.window("_t", size), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
