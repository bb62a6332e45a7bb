"""Live ledgers and windows over event streams."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimspark.operators.replay import STEPS
from claimspark.session import scratch_root


class Ledger:
    """What one claim's events have come to: per observation its live items and log evidence."""

    def __init__(self, prior: float, state: dict | None = None):
        self.prior, self.groups = prior, dict(state or {})  # group -> [items, log evidence]

    def apply(self, action: str, group: str, log_evidence: float) -> bool:
        """admit, withdraw or correct; whether the active set or a score has changed."""
        items, score = self.groups.get(group, (0, 0.0))
        if action == "admit":
            self.groups[group] = (items + 1, score if items else log_evidence)
            return items == 0
        if not items:
            return False
        if action == "withdraw":
            self.groups[group] = (items - 1, score)
            return items == 1
        self.groups[group] = (items, log_evidence)
        return log_evidence != score

    @property
    def active(self) -> int:
        return sum(1 for items, _ in self.groups.values() if items)

    def probability(self) -> float:
        odds = math.log(self.prior) - math.log1p(-self.prior) + math.fsum(s for items, s in self.groups.values() if items)
        return 1 / (1 + math.exp(-odds)) if odds >= 0 else math.exp(odds) / (1 + math.exp(odds))


def live_ledger(events: DataFrame, prior: float = 0.5, late: str | None = None) -> DataFrame:
    """The rows of replay() from a stream of (claim, seq, action, group, log_evidence), each claim's ledger kept as state between micro-batches.

    Without `late`, events are applied as they come, each micro-batch in order of seq. With it (events then have `at`, and seq follows it), an event
    that is delivered twice within that time counts once, and events wait until the watermark has passed them, so that
    late ones take their place and the rows are those of replay() whatever the order of arrival; what is later still is dropped. A claim's waiting
    events are bounded by `late`.
    """
    steps = T.StructType([events.schema["claim"], *STEPS.fields[1:]])  # claims of any type
    if late:
        events = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["claim", "seq"])

    def fold(key, batches, state: GroupState):
        import json

        import pandas as pd

        groups, waiting = json.loads(state.get[0]) if state.exists else ({}, [])
        ledger = Ledger(prior, {g: tuple(v) for g, v in groups.items()})
        for rows in batches:
            at = rows["at"].astype("datetime64[ms]").astype("int64") if late else [0] * len(rows)
            waiting += [[int(t), int(r.seq), r.group, r.action, float(r.log_evidence)] for t, r in zip(at, rows.itertuples())]
        passed = state.getCurrentWatermarkMs() if late else 0
        ready = sorted((w for w in waiting if w[0] <= passed), key=lambda w: w[1:3])
        waiting = [w for w in waiting if w[0] > passed]
        out = []
        for _, seq, group, action, log_evidence in ready:
            changed = ledger.apply(action, group, log_evidence)
            out.append((key[0], seq, action, ledger.active, changed, ledger.probability()))
        state.update((json.dumps([ledger.groups, waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, min(w[0] for w in waiting)))
        if out:
            yield pd.DataFrame(out, columns=steps.names)

    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return events.groupBy("claim").applyInPandasWithState(fold, steps, "state string", "append", timeout)


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream has come to when all that is there has been read: its last complete table, or all its rows in append mode.

    The table is written to the shared folder by the stream itself, each batch of rows in a place of its own, so a batch that is tried again
    replaces what it has left, and a restart goes on from the stream's own checkpoint.
    """
    spark = stream.sparkSession
    root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/rows" if mode == "complete" else f"{root}/rows/batch={i}")
    query = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/progress").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows").select(*stream.columns)


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """start, kind, n, total of fixed windows over (at, kind, value); a watermark of `late` bounds a stream's state."""
    if events.isStreaming and late:
        events = events.withWatermark("at", late)
    out = events.groupBy(F.window("at", width), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "kind", "n", "total")


def sliding(events: DataFrame, width: str, slide: str) -> DataFrame:
    """start, n of overlapping windows."""
    return events.groupBy(F.window("at", width, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """claim, start, end, n of runs of events with no gap as long as `gap`."""
    out = events.groupBy(F.session_window("at", gap), "claim").agg(F.count(F.lit(1)).alias("n"))
    return out.select("claim", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
