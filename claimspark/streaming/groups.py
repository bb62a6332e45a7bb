"""Observations reconciled while their items arrive, in whatever order: what a late original changes is sent as corrections."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimspark.functions.text import family_key
from claimspark.session import scratch_root

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Ids in one entry of a list that is kept as state.
CHUNK = 128
#: Items up to which a claim's state is one entry: it is read and written at once, and all of it is worked out anew.
SMALL = 512


class Entries:
    """A map kept as state, of which an arrival reads and writes each entry once."""

    def __init__(self, state):
        self.state, self.held, self.changed, self.empty = state, {}, set(), False

    def getValue(self, key: tuple) -> tuple | None:  # noqa: N802  as the state's own
        if key not in self.held:
            self.held[key] = None if self.empty else self.state.getValue(key)
        return self.held[key]

    def updateValue(self, key: tuple, value: tuple | None) -> None:  # noqa: N802
        self.held[key] = value
        self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            if self.held[key] is not None:
                self.state.updateValue(key, self.held[key])
            elif not self.empty and self.state.containsKey(key):
                self.state.removeKey(key)
        self.held, self.changed, self.empty = {}, set(), False


class Lists:
    """Lists of ids by (kind, name), in entries of up to CHUNK, so that a long list costs one entry to append to."""

    def __init__(self, handle: StatefulProcessorHandle, id_type: T.DataType, ttl: int | None):
        key = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("chunk", T.IntegerType())])
        self.entries = Entries(handle.getMapState("lists", key, T.StructType([T.StructField("ids", T.ArrayType(id_type))]), ttl))
        sizes = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())])
        self.sizes = Entries(handle.getMapState("sizes", sizes, T.StructType([T.StructField("n", T.IntegerType())]), ttl))

    def size(self, kind: str, name: str) -> int:
        found = self.sizes.getValue((kind, name))
        return found[0] if found else 0

    def get(self, kind: str, name: str) -> list:
        return [i for c in range(-(-self.size(kind, name) // CHUNK)) for i in self.entries.getValue((kind, name, c))[0]]

    def append(self, kind: str, name: str, id_) -> None:
        n = self.size(kind, name)
        held = list(self.entries.getValue((kind, name, n // CHUNK))[0]) if n % CHUNK else []
        self.entries.updateValue((kind, name, n // CHUNK), ([*held, id_],))
        self.sizes.updateValue((kind, name), (n + 1,))

    def replace(self, kind: str, name: str, ids: list) -> None:
        for c in range(-(-len(ids) // CHUNK)):
            self.entries.updateValue((kind, name, c), (ids[c * CHUNK : (c + 1) * CHUNK],))
        self.sizes.updateValue((kind, name), (len(ids),))


class Item:
    """An admitted item, the set of items it hangs together with, and what was last sent of it."""

    FIELDS = ("span", "target", "wording", "repeats", "label", "group", "origin")

    def __init__(self, id_, *values):
        self.id = id_
        for name, value in zip(self.FIELDS, values):
            setattr(self, name, value)

    def values(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)


def regrouped(items: list[Item], originals: dict) -> dict:
    """{id: (label, group, origin)} of items that hang together with no others; originals: {span: the id that a repetition of it goes to}."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    of = {i.id: originals.get(i.repeats) if i.repeats is not None else None for i in items}
    for i in items:
        for other in [("w", i.wording)] + ([("i", of[i.id])] if of[i.id] is not None else []):
            parent[root(("i", i.id))] = root(other)
    sets: dict = {}
    for i in items:
        sets.setdefault(root(("i", i.id)), []).append(i)
    out = {}
    for own in sets.values():
        first = min(i.id for i in own)
        name = min((i.wording for i in own if of[i.id] is None), default=None) or min(i.wording for i in own)
        out |= {i.id: (str(first), name, "independent" if of[i.id] is None else "repetition") for i in own}
    return out


def admitted(items: list[Item]) -> list[Item]:
    """The least id for each span and target."""
    held: dict = {}
    for i in items:
        if (i.span, i.target) not in held or i.id < held[i.span, i.target].id:
            held[i.span, i.target] = i
    return list(held.values())


def originals_of(items: list[Item]) -> dict:
    """{span: the id that a repetition of it goes to}: the least of those about the claim, else of all."""
    found: dict = {}
    for i in items:
        at = (i.target != "claim", i.id)
        if i.span not in found or at < found[i.span]:
            found[i.span] = at
    return {span: id_ for span, (_, id_) in found.items()}


class Reconciler(StatefulProcessor):
    """One claim's items. While they are SMALL in number they are one entry; from then on, what an arrival doesn't touch is neither read nor written."""

    def __init__(self, id_type: T.DataType, out: T.StructType, ttl: int | None):
        self.id_type, self.out, self.ttl = id_type, out, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
        id_ = T.StructType([T.StructField("id", self.id_type)])
        self.items = Entries(handle.getMapState("items", id_, text(*Item.FIELDS), self.ttl))
        self.words = Entries(handle.getMapState("words", text("wording"), text("label"), self.ttl))
        self.names = Entries(handle.getMapState("names", text("label"), text("name", "origin"), self.ttl))
        self.lists = Lists(handle, self.id_type, self.ttl)
        # What the claim's items are, by columns, while they are few; a row without items where they have entries of their own.
        few = [T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(self.id_type)), *[T.StructField(f, T.ArrayType(T.StringType())) for f in Item.FIELDS]]
        self.few = handle.getValueState("few", T.StructType(few), self.ttl)

    def item(self, id_) -> Item | None:
        found = self.items.getValue((id_,))
        return Item(id_, *found) if found else None

    def on_span(self, span: str) -> list[Item]:
        return [i for i in map(self.item, self.lists.get("span", span)) if i is not None]

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N803
        import pandas as pd

        arrived = [Item(r.id, r.span, r.target, r.wording, r.repeats if isinstance(r.repeats, str) else None, None, None, None) for r in pd.concat(list(rows)).sort_values("id").itertuples()]
        held = self.few.get()
        n, ids, *columns = held or (0, [])
        old = [Item(*x) for x in zip(ids, *columns)] if ids else []
        if self.ttl is None and (held is None or ids):
            changed, own = self.anew(old, arrived)
        else:
            changed, own = self.one_by_one(arrived), None
        if changed:
            stored = own if own is not None and len(own) <= SMALL else []
            self.few.update((n + 1, [i.id for i in stored], *([getattr(i, f) for i in stored] for f in Item.FIELDS)))
            if own is not None and not stored:
                self.spread(own)
            yield pd.DataFrame([(key[0], i, group, origin, n + 1) for i, (group, origin) in changed.items()], columns=self.out.names)

    def anew(self, old: list[Item], arrived: list[Item]) -> tuple[dict, list[Item]]:
        """What changes by the arrivals, and all items of the claim with what they are now."""
        own = admitted([*old, *arrived])
        made = regrouped(own, originals_of(own))
        left = {i.id for i in own}
        changed = {i.id: (None, "replaced") for i in old if i.id not in left}
        for i in own:
            label, group, origin = made[i.id]
            if (group, origin) != (i.group, i.origin):
                changed[i.id] = (group, origin)
            i.label, i.group, i.origin = label, group, origin
        return changed, own

    def spread(self, own: list[Item]) -> None:
        """Gives the items entries of their own, of which there are none yet."""
        states = (self.items, self.words, self.names, self.lists.entries, self.lists.sizes)
        for state in states:
            state.empty = True
        alone = {i.label for i in own if i.origin == "independent"}
        members: dict = {}
        for i in sorted(own, key=lambda i: i.id):
            self.keep(i)
            self.words.updateValue((i.wording,), (i.label,))
            self.names.updateValue((i.label,), (i.group, "independent" if i.label in alone else "repetition"))
            members.setdefault(i.label, []).append(i.id)
        for label, ids in members.items():
            self.lists.replace("member", label, ids)
        for state in states:
            state.flush()

    def one_by_one(self, arrived: list[Item]) -> dict:
        changed: dict = {}
        for x in arrived:
            self.admit(x, changed)
        for state in (self.items, self.words, self.names, self.lists.entries, self.lists.sizes):
            state.flush()
        return changed

    def admit(self, x: Item, changed: dict) -> None:
        held = self.on_span(x.span)
        twin = next((i for i in held if i.target == x.target), None)
        if twin is not None and twin.id <= x.id:
            return  # delivered again, or a later item for the same span and target
        originals = self.lists.get("span", x.repeats) if x.repeats is not None else []
        label = self.words.getValue((x.wording,))
        name = self.names.getValue(label) if label else None
        plain = twin is None and not originals and not self.lists.size("repeats", x.span) and x.repeats != x.span
        if plain and (name is None or (name[1] == "independent" and name[0] <= x.wording)):
            x.label, x.group, x.origin = (label[0], name[0], "independent") if name else (str(x.id), x.wording, "independent")
            if name is None:
                self.words.updateValue((x.wording,), (x.label,))
                self.names.updateValue((x.label,), (x.group, "independent"))
            self.keep(x)
            self.lists.append("member", x.label, x.id)
            changed[x.id] = (x.group, x.origin)
            return
        self.keep(x)
        # The sets of everything that the arrival can join, or that can lose an original by it.
        near = [*self.on_span(x.span), *filter(None, map(self.item, self.lists.get("repeats", x.span))), *filter(None, map(self.item, originals))]
        labels = {i.label for i in near if i.label} | ({label[0]} if label else set())
        members = {i: self.item(i) for each in labels for i in self.lists.get("member", each)} | {x.id: x}
        if twin is not None:
            self.items.updateValue((twin.id,), None)
            members.pop(twin.id, None)
            changed[twin.id] = (None, "replaced")
        own = [i for i in members.values() if i is not None]
        self.regroup(own, labels, changed)

    def keep(self, x: Item) -> None:
        self.items.updateValue((x.id,), x.values())
        self.lists.append("span", x.span, x.id)
        if x.repeats is not None:
            self.lists.append("repeats", x.repeats, x.id)

    def regroup(self, own: list[Item], labels: set, changed: dict) -> None:
        spans = {i.repeats for i in own if i.repeats is not None}
        originals = {s: min(found, key=lambda i: (i.target != "claim", i.id)).id for s in spans if (found := self.on_span(s))}
        made = regrouped(own, originals)
        for label in labels:
            self.lists.replace("member", label, [])
        by_label: dict = {}
        for i in own:
            label, group, origin = made[i.id]
            if (group, origin) != (i.group, i.origin):
                changed[i.id] = (group, origin)
            if (label, group, origin) != (i.label, i.group, i.origin):
                i.label, i.group, i.origin = label, group, origin
                self.items.updateValue((i.id,), i.values())
            by_label.setdefault(label, []).append(i)
        for label, those in by_label.items():
            self.lists.replace("member", label, sorted(i.id for i in those))
            alone = any(i.origin == "independent" for i in those)
            self.names.updateValue((label,), (those[0].group, "independent" if alone else "repetition"))
            for wording in {i.wording for i in those}:
                self.words.updateValue((wording,), (label,))

    def close(self) -> None:
        pass


def live_groups(items: DataFrame, ttl: int | None = None) -> DataFrame:
    """The rows of reconcile.groups() from a stream of (claim, id, span, target, quote, repeats), as they change.

    Each row (claim, id, group, origin, revision) is what an item's group is from then on; `latest` keeps the last of each. Items may come in any order and more than once: a late
    original takes its earlier repetitions along, and a lesser id for a span and target replaces the greater one, whose group is then null. A claim of up to
    SMALL items is one entry of the state; a larger one has single entries, so an item that joins a large group costs a few of them. With `ttl`, milliseconds after which an entry that isn't
    written again is forgotten, state is bounded; what comes later than that is reconciled with what is left.
    """
    spark = items.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    scratch_root(spark)
    read = items.select("claim", "id", "span", "target", family_key("quote").alias("wording"), "repeats")
    out = T.StructType([items.schema["claim"], items.schema["id"], T.StructField("group", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("revision", T.LongType())])
    return read.groupBy("claim").transformWithStateInPandas(Reconciler(items.schema["id"].dataType, out, ttl), out, "Append", "ProcessingTime" if ttl else "None")


def latest(rows: DataFrame) -> DataFrame:
    """claim, id, group, origin: what the rows of live_groups have come to."""
    last = rows.groupBy("claim", "id").agg(F.max_by(F.struct("group", "origin"), "revision").alias("v"))
    return last.where("v.group is not null").select("claim", "id", "v.group", "v.origin")
