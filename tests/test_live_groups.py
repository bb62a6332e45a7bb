"""Items that arrive in any order, late and more than once end in the rows of the batch form."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import types as T

from claimspark.operators import reconcile
from claimspark.streaming import groups as live

TYPE = "claim long, id long, span string, target string, quote string, repeats string"


def told(df):
    return sorted((r["claim"], r["id"], r["group"], r["origin"]) for r in df.collect())


def streamed(spark, tmp_path, batches, **more):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    stream = live.live_groups(spark.readStream.schema(TYPE).option("maxFilesPerTrigger", 1).parquet(str(source)), **more)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start(str(out))
    try:
        for rows in batches:
            spark.createDataFrame(rows, TYPE).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(str(out))


@pytest.mark.parametrize("small", [0, 20, 512])
def test_small_states_of_one_entry_and_large_ones_have_the_batch_rows(small, monkeypatch):
    """Claims of entries of their own, those that outgrow their one entry on the way, and small ones, over a state that is a dictionary."""
    monkeypatch.setattr(live, "SMALL", small)
    monkeypatch.setattr(live, "CHUNK", 3)
    for seed in range(30):
        r = random.Random(seed)
        items = [live.Item(i, f"s{r.randrange(25)}", r.choice(["claim", "q1", "q2"]), f"w{r.randrange(12)}", f"s{r.randrange(25)}" if r.random() < 0.35 else None, None, None, None) for i in range(60)]
        want_of = live.admitted(items)
        want = {i: (group, origin) for i, (_, group, origin) in live.regrouped(want_of, live.originals_of(want_of)).items()}
        order = [*items, *items[:20]]
        r.shuffle(order)
        handle = Handle()
        processor = live.Reconciler(T.LongType(), T.StructType([T.StructField(n, T.LongType()) for n in ("claim", "id", "group", "origin", "revision")]), None)
        processor.init(handle)
        last: dict = {}
        for a in range(0, len(order), 13):
            rows = pd.DataFrame([(i.id, i.span, i.target, i.wording, i.repeats) for i in order[a : a + 13]], columns=["id", "span", "target", "wording", "repeats"])
            for out in processor.handleInputRows((1,), iter([rows]), None):
                last |= {x.id: (x.group, x.origin) for x in out.itertuples()}
        assert {i: v for i, v in last.items() if v[0] is not None} == want


def test_a_small_claim_costs_two_calls_of_the_state():
    handle = Handle()
    processor = live.Reconciler(T.LongType(), T.StructType([T.StructField(n, T.LongType()) for n in ("claim", "id", "group", "origin", "revision")]), None)
    processor.init(handle)
    rows = pd.DataFrame([(i, f"s{i % 50}", "claim", f"w{i % 9}", f"s{i % 7}" if i % 3 else None) for i in range(200)], columns=["id", "span", "target", "wording", "repeats"])
    list(processor.handleInputRows((1,), iter([rows]), None))
    assert handle.calls <= 2


class Handle:
    """A claim's state as dictionaries, which counts what it is asked."""

    def __init__(self):
        self.calls = 0

    def getMapState(self, name, key, value, ttl=None):  # noqa: N802  as the state's own
        return Held(self)

    getValueState = lambda self, name, schema, ttl=None: Held(self)  # noqa: E731, N815


class Held:
    def __init__(self, handle):
        self.handle, self.values = handle, {}

    def called(self, out=None):
        self.handle.calls += 1
        return out

    def get(self):
        return self.called(self.values.get(()))

    def update(self, value):
        self.called(self.values.update({(): value}))

    def exists(self):
        return self.called(() in self.values)

    def getValue(self, key):  # noqa: N802
        return self.called(self.values.get(key))

    def updateValue(self, key, value):  # noqa: N802
        self.called(self.values.update({key: value}))

    def containsKey(self, key):  # noqa: N802
        return self.called(key in self.values)

    def removeKey(self, key):  # noqa: N802
        self.called(self.values.pop(key))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_ends_in_the_batch_rows(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(live, "CHUNK", 3)
    r = random.Random(seed)
    items = []
    for i in range(90):
        repeats = f"s{r.randrange(25)}" if r.random() < 0.35 else None
        items.append((r.randrange(3), i, f"s{r.randrange(25)}", r.choice(["claim", "q1", "q2"]), f"Finding {r.randrange(12)}{r.choice(['', '!'])}", repeats))
    want = told(reconcile.groups(spark.createDataFrame(items, TYPE)))
    order = [*items, *items[:20]]
    r.shuffle(order)
    rows = streamed(spark, tmp_path, [order[a : a + 28] for a in range(0, len(order), 28)])
    assert told(live.latest(rows)) == want
    assert rows.count() < 3 * len(items)  # corrections only where something has changed


def test_a_late_original_takes_its_repetition_along(spark, tmp_path):
    original, repetition, copy = (1, 1, "s1", "claim", "Emissions per unit fell 40%.", None), (1, 2, "s2", "claim", "The firm says intensity dropped two fifths", "s1"), (1, 3, "s3", "claim", "The firm says intensity dropped two fifths", None)
    for n, order in enumerate(itertools.permutations([original, repetition, copy])):
        if n % 2:
            continue  # three of the six orders, each with another item last
        (tmp_path / str(n)).mkdir()
        rows = streamed(spark, tmp_path / str(n), [[x] for x in order])
        found = told(live.latest(rows))
        assert len({g for _, _, g, _ in found}) == 1 and [o for *_, o in found] == ["independent", "repetition", "independent"]
        assert told(live.latest(rows)) == told(reconcile.groups(spark.createDataFrame(order, TYPE)))
