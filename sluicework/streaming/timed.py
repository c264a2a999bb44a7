"""Sessions with timers: a stateful stream that abandons what stays idle and tells hints that come too early, and the same as a batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session may idle before it counts as abandoned, and what must lie between two hints, in seconds.
IDLE, COOLDOWN = 3600, 300
OUT = T.StructType([T.StructField(n, k) for n, k in (("session", T.StringType()), ("state", T.StringType()), ("hints", T.LongType()), ("early", T.LongType()), ("illegal", T.LongType()), ("ended", T.LongType()))])
_NOW = T.StructType([T.StructField(n, k) for n, k in (("state", T.StringType()), ("illegal", T.LongType()), ("last_seq", T.LongType()), ("last", T.LongType()), ("ended", T.LongType()), ("timer", T.LongType()))])


def _events(log: DataFrame) -> DataFrame:
    """(session, seq, event, at in seconds, time) of rows without nulls."""
    rows = log.where("session is not null and seq is not null and event is not null and at is not null")
    return rows.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "event", F.unix_seconds(F.col("at").cast("timestamp")).alias("second"), F.col("at").cast("timestamp").alias("at"))


def fold_timed(log: DataFrame, idle: int = IDLE, cooldown: int = COOLDOWN, delay: int = 0) -> DataFrame:
    """session, state, hints, early, illegal, ended (seconds) of a log (session, seq, event, at), by seq.

    The first start opens a session. It ends with the first finish or abandon after that, or where more than ``idle`` seconds pass
    before the next event or, after its last, before the latest time of the log less ``delay``: then it is abandoned at
    the end of these seconds. Hints count while it is open; one that comes within ``cooldown`` seconds of the one before is early.
    Every other event is illegal. Rows with a null are ignored. Windows by session and aggregates only.
    """
    rows = _events(log)
    w = W.partitionBy("session").orderBy("seq")
    rows = rows.withColumn("_from", F.min(F.when(F.col("event") == "start", F.col("seq"))).over(W.partitionBy("session")))
    inside = F.col("seq") > F.col("_from")
    before = F.max("second").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_gap", inside & (F.col("second") - before > idle)).withColumn("_before", before)
    over = inside & (F.col("_gap") | F.col("event").isin("finish", "abandon"))
    rows = rows.withColumn("_to", F.min(F.when(over, F.col("seq"))).over(W.partitionBy("session")))
    hint = inside & (F.col("event") == "hint") & (F.col("_to").isNull() | (F.col("seq") < F.col("_to")))
    rows = rows.withColumn("_hint", hint).withColumn("_last_hint", F.last(F.when(hint, F.col("second")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    at_end = F.col("seq") == F.col("_to")
    legal = F.col("_hint") | (F.col("seq") == F.col("_from")) | (at_end & ~F.col("_gap"))
    sums = rows.groupBy("session").agg(
        F.max("_from").alias("from"), F.max("_to").alias("to"), F.max(F.when(at_end, F.when(F.col("_gap"), "gap").otherwise(F.col("event")))).alias("end"),
        F.max(F.when(at_end, F.when(F.col("_gap"), F.col("_before") + idle).otherwise(F.col("second")))).alias("ended"), F.max("second").alias("latest"),
        F.count_if("_hint").alias("hints"), F.count_if(F.col("_hint") & (F.col("second") - F.col("_last_hint") < cooldown)).alias("early"), F.count_if(~F.coalesce(legal, F.lit(False))).alias("illegal"),
    )
    now = rows.agg((F.max("second") - delay).alias("now"))  # one row
    met = sums.join(F.broadcast(now)).withColumn("left", F.col("from").isNotNull() & F.col("to").isNull() & (F.col("latest") + idle < F.col("now")))
    state = F.when(F.col("from").isNull(), "none").when(F.col("end") == "finish", "finished").when(F.col("end").isNotNull() | F.col("left"), "abandoned").otherwise("open")
    return met.select("session", state.alias("state"), "hints", "early", "illegal", F.when(F.col("left"), F.col("latest") + idle).otherwise(F.col("ended")).alias("ended"))


class Sessions(StatefulProcessor):
    """One session's state as values, its hints as a map (seq to second) that is dropped when it ends, and a timer of event time."""

    def __init__(self, idle: int, cooldown: int) -> None:
        self.idle, self.cooldown = idle, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", _NOW)
        counts = T.StructType([T.StructField("hints", T.LongType()), T.StructField("early", T.LongType())])
        self.counts = handle.getMapState("counts", T.StructType([T.StructField("name", T.StringType())]), counts)
        self.hint = handle.getValueState("hint", T.StructType([T.StructField("second", T.LongType())]))

    def _told(self, key: tuple, now: tuple) -> Row:
        hints, early = self.counts.getValue(("all",)) if self.counts.containsKey(("all",)) else (0, 0)
        return Row(session=key[0], state=now[0], hints=hints, early=early, illegal=now[1], ended=now[4])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        now = tuple(self.now.get()) if self.now.exists() else ("none", 0, None, None, None, None)
        hints, early = self.counts.getValue(("all",)) if self.counts.containsKey(("all",)) else (0, 0)
        last_hint = self.hint.get()[0] if self.hint.exists() else None
        timer = now[5]
        for r in sorted(rows, key=lambda r: r["seq"]):
            state, illegal, last_seq, last, ended, _ = now
            second, event = r["second"], r["event"]
            if last_seq is not None and r["seq"] < last_seq:  # came after one that follows it
                now = (state, illegal + 1, last_seq, last, ended, timer)
                continue
            if state == "open" and second - last > self.idle:
                state, ended, last_hint = "abandoned", last + self.idle, None
            if state == "none" and event == "start":
                state = "open"
            elif state == "open" and event == "hint":
                hints, early, last_hint = hints + 1, early + (last_hint is not None and second - last_hint < self.cooldown), second
            elif state == "open" and event in ("finish", "abandon"):
                state, ended = {"finish": "finished", "abandon": "abandoned"}[event], second
            else:
                illegal += 1
            now = (state, illegal, r["seq"], second if last is None else max(last, second), ended, timer)
        due = (now[3] + self.idle + 1) * 1000 if now[0] == "open" else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        now = (*now[:5], due)
        self.counts.updateValue(("all",), (hints, early))
        if now[0] == "open" and last_hint is not None:
            self.hint.update((last_hint,))
        else:
            self.hint.clear()
        self.now.update(now)
        yield self._told(key, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        now = tuple(self.now.get())
        if now[0] == "open":
            now = ("abandoned", now[1], now[2], now[3], now[3] + self.idle, None)
            self.now.update(now)
            self.hint.clear()
            yield self._told(key, now)

    def close(self) -> None:
        pass


def fold_timed_stream(log: DataFrame, idle: int = IDLE, cooldown: int = COOLDOWN, delay: str = "0 seconds") -> DataFrame:
    """fold_timed() of a stream, in update mode: sessions that changed, as they now stand; those that idle change when event time has passed.

    Needs the RocksDB state store. A session keeps a few numbers, whatever its events. Events of a batch are taken by seq; one
    that comes in a later batch than an event of a higher seq is illegal, one later than ``delay`` is dropped by Spark.
    """
    rows = _events(log).withWatermark("at", delay)
    return rows.groupBy("session").transformWithState(Sessions(idle, cooldown), OUT, "Update", "EventTime")
