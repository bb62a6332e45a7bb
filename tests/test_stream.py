"""A live ledger whose events come late, out of order and twice gives the rows of the replay."""

import random
from datetime import datetime, timedelta

from claimspark.operators import replay
from claimspark.streaming import ledger as live

TYPE = "claim long, seq long, at timestamp, action string, group string, log_evidence double"


def test_late_and_repeated_events(spark, tmp_path):
    r = random.Random(2)
    start = datetime(2024, 1, 1)
    events = [(r.randrange(3), i, start + timedelta(minutes=i), r.choice(["admit", "admit", "withdraw", "correct"]), r.choice("gh"), r.randrange(-40, 40) / 16) for i in range(60)]
    near = lambda x: (*x[:5], round(x[5], 12))  # noqa: E731  two math libraries differ in the last bit
    want = sorted(map(near, replay.replay(spark.createDataFrame(events, TYPE)).collect()))
    source, out = tmp_path / "in", []
    source.mkdir()
    stream = live.live_ledger(spark.readStream.schema(TYPE).parquet(str(source)), late="30 minutes")
    query = stream.writeStream.foreachBatch(lambda batch, _: out.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for i in range(0, 60, 20):
            part = events[i : i + 20] + events[max(0, i - 8) : i]  # some are delivered again
            r.shuffle(part)
            half = len(part) // 2
            for some in (part[half:], part[:half]):
                spark.createDataFrame(some, TYPE).coalesce(1).write.mode("append").parquet(str(source))
                query.processAllAvailable()
        end = [(99, 1000, start + timedelta(days=2), "admit", "g", 0.0)]  # moves the watermark past all others
        spark.createDataFrame(end, TYPE).coalesce(1).write.mode("append").parquet(str(source))
        query.processAllAvailable()
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(near(x) for x in out if x[0] != 99)
    assert got == want


def test_claims_may_be_text(spark, tmp_path):
    kind = TYPE.replace("claim long", "claim string")
    spark.createDataFrame([("c-1", 1, datetime(2024, 1, 1), "admit", "g", 0.5)], kind).write.parquet(str(tmp_path / "in"))
    rows = live.drained(live.live_ledger(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))), "text-claims", "append").collect()
    assert [(r["claim"], r["active"]) for r in rows] == [("c-1", 1)]
