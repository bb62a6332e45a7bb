"""Merges of observations with their history: what each group was at any time, and which group holds a former one's items.

Events: (claim, seq, action, group, into). admit adds an item to the group that holds `group` now, withdraw takes one (of none, nothing), merge joins the active
`group` to the active `into`, which keeps all items. A group begins at version 1; its version rises with each withdrawal, each admission after it was empty, and on
both sides of a merge. A merge of a group with itself or with a group that isn't active is refused and changes nothing.

Which merges stand depends on those before them, so groups that merges name together, over any number of steps, are folded in order of seq. That is the only
sequential part: its key is such a set of groups and not the claim, a task streams its events and holds the set's groups, never the events.
Everything asked of the history afterwards is a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.operators.components import components
from claimspark.operators.sizes import broadcast_if_small
from claimspark.session import materialize

FIELDS = T.StructType(
    [
        T.StructField("seq", T.LongType()), T.StructField("action", T.StringType()), T.StructField("group", T.StringType()), T.StructField("version", T.LongType()), T.StructField("members", T.LongType()),
        T.StructField("into", T.StringType()), T.StructField("outcome", T.StringType()),
    ]
)
ADMIT, WITHDRAW, MERGE = "admit", "withdraw", "merge"


class Groups:
    """The groups of one set, as they are after the events so far."""

    def __init__(self):
        self.held: dict[str, list] = {}  # group -> [version, members, merged into]

    def current(self, group: str) -> str:
        """The group that holds the items of `group` now; pointers on the way are shortened."""
        path = []
        while group in self.held and self.held[group][2] is not None:
            path.append(group)
            group = self.held[group][2]
        for g in path[:-1]:
            self.held[g][2] = group
        return group

    def active(self, group: str) -> bool:
        return group in self.held and self.held[group][1] > 0

    def apply(self, action: str, group: str, into: str | None) -> Iterator[tuple]:
        """(group, version, members, into, outcome) of each group that the event touches."""
        if action == MERGE:
            if group == into or not (self.active(group) and self.active(into)):
                version, members, _ = self.held.get(group, (None, 0, None))
                yield group, version, members, None, "self" if group == into else "inactive"
                return
            keep, drop = self.held[into], self.held[group]
            keep[0], keep[1] = keep[0] + 1, keep[1] + drop[1]
            drop[0], drop[1], drop[2] = drop[0] + 1, 0, into
            yield into, keep[0], keep[1], None, "merged"
            yield group, drop[0], 0, into, "merged"
            return
        group = self.current(group)
        held = self.held.setdefault(group, [1, 0, None]) if action == ADMIT else self.held.get(group)
        outcome = "none"
        if action == ADMIT:
            outcome = "admitted" if held[1] else "new" if held[0] == 1 and not held[2] else "again"
            held[0], held[1] = held[0] + (outcome == "again"), held[1] + 1
        elif action == WITHDRAW and held and held[1]:
            held[0], held[1], outcome = held[0] + 1, held[1] - 1, "withdrawn"
        yield group, held and held[0], held[1] if held else 0, None, outcome


def history(events: DataFrame) -> DataFrame:
    """claim and FIELDS: a row for each event and, for a merge that stands, one for each side: the group that it touched, the group's version and items after it, what a dropped
    group went into, and the outcome (new, admitted, again, withdrawn, none, merged, self or inactive).

    Events of one set of groups that share a seq go by action, group, into. Null groups are groups like any other, named by no merge that stands.
    """
    merged = events.where(F.col("action") == MERGE).where("group <> into").select("claim", F.col("group").alias("a"), F.col("into").alias("b")).distinct()
    name = lambda c: F.to_json(F.struct(F.col("claim").alias("c"), F.col(c).alias("g")))
    labels = components(merged.select(name("a").alias("a"), name("b").alias("b"))).select(F.col("node").alias("own"), F.col("label").alias("label"))
    keyed = events.withColumn("own", name("group")).join(broadcast_if_small(labels), "own", "left").withColumn("key", F.coalesce("label", "own"))
    lined = keyed.repartition("key").sortWithinPartitions("key", "seq", "action", F.col("group").asc_nulls_first(), F.col("into").asc_nulls_first()).select("key", "claim", "seq", "action", "group", "into")
    schema = T.StructType([events.schema["claim"], *FIELDS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        key, groups = None, Groups()
        for batch in batches:
            out: list[tuple] = []
            for k, claim, seq, action, group, into in zip(*(batch[c].to_pylist() for c in ("key", "claim", "seq", "action", "group", "into"))):
                if k != key:
                    key, groups = k, Groups()
                out += [(claim, seq, action, *touched) for touched in groups.apply(action, group, into)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(fields), fields)], schema=fields)

    return lined.mapInArrow(run, schema)


def merges(past: DataFrame) -> DataFrame:
    """claim, drop, keep, at: the merges that stand; a group is dropped once at most."""
    return past.where("into is not null").select("claim", F.col("group").alias("drop"), F.col("into").alias("keep"), F.col("seq").alias("at"))


def lifted(stands: DataFrame) -> list[DataFrame]:
    """Tables of (claim, drop, keep, at): where 1, 2, 4, … merges in a row take a group, and the seq of the last of them. Merges on the way up are ever later."""
    levels = [materialize(stands, "merges")]
    while True:
        low = levels[-1]
        up = low.select("claim", F.col("drop").alias("keep"), F.col("keep").alias("top"), F.col("at").alias("later"))
        high = materialize(low.join(up, ["claim", "keep"]).select("claim", "drop", F.col("top").alias("keep"), F.col("later").alias("at")), "merges")
        if high.isEmpty():
            return levels
        levels.append(high)


def groups_at(asked: DataFrame, stands: DataFrame, at: str = "seq") -> DataFrame:
    """asked (claim, group, at, …) with `holder`: the group that holds the group's items after the events up to `at`, by as many joins as the
    logarithm of the longest chain of merges."""
    out = asked.withColumn("holder", F.col("group"))
    for level in reversed(lifted(stands)):
        step = level.select(F.col("claim").alias("__claim"), F.col("drop").alias("__drop"), F.col("keep").alias("__keep"), F.col("at").alias("__at"))
        same = F.col("claim").eqNullSafe(F.col("__claim")) & (F.col("holder") == F.col("__drop")) & (F.col("__at") <= F.col(at))
        out = out.join(broadcast_if_small(step), same, "left").withColumn("holder", F.coalesce("__keep", "holder")).select(*asked.columns, "holder")
    return out


def rewritten(lineage: DataFrame, stands: DataFrame, at: str = "seq") -> DataFrame:
    """claim, calculation, at, group: what calculations (claim, calculation, group, at) rest on after the merges up to `at`, each observation once."""
    return groups_at(lineage, stands, at).select("claim", "calculation", at, F.col("holder").alias("group")).distinct()
