"""Queries on the history of observations: merges, holders at a version, streams of corrections. Roles as in record_queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.operators import merges
from claimspark.plans import claim_queries
from claimspark.plans.claim_queries import as_items
from claimspark.plans.record_queries import EV, as_evidence, evidence
from claimspark.session import table
from claimspark.streaming import groups
from claimspark.streaming.ledger import drained

#: Observations of a claim.
GROUPS = 7


def merge_events(spark, d) -> DataFrame:
    """Events as they are, but every third click joins its observation to another one."""
    e = evidence(spark, d)
    joins = (F.col("status") == "click") & (F.col("k") % 3 == 0)
    into = F.concat(F.lit("g"), ((F.col("k") / GROUPS).cast("int") % GROUPS).cast("string"))
    action = F.when(joins, "merge").when(F.col("action") == "withdraw", "withdraw").otherwise("admit")
    return e.select("claim", "seq", action.alias("action"), "group", F.when(joins, into).alias("into"))


def merge_history(spark, d):
    return merges.history(merge_events(spark, d))


def group_at_version(spark, d):
    """Which group holds each event's observation at that event, five hundred events on and at last."""
    events = merge_events(spark, d)
    stands = merges.merges(merges.history(events))
    asked = events.select("claim", "group", "seq", F.explode(F.array(F.col("seq"), F.col("seq") + 500, F.lit(1 << 62))).alias("upto"))
    return merges.groups_at(asked, stands, "upto").groupBy("claim", "group", "upto", "holder").agg(F.count(F.lit(1)).alias("events")).where("upto < 1000000000000 or `group` <> holder")


def lineage_after_merges(spark, d):
    """Calculations read the observations of ten adjoining events; what they rest on now."""
    events = merge_events(spark, d)
    reads = events.select("claim", F.floor(F.col("seq") / 10).alias("calculation"), "group", F.lit(1 << 62).alias("seq")).distinct()
    out = merges.rewritten(reads, merges.merges(merges.history(events)))
    return out.groupBy("claim", "calculation").agg(F.array_join(F.array_sort(F.collect_list("group")), "+").alias("lineage"))


def stream_groups(spark, d):
    """The items of reconcile_groups as a stream, the last that is sent of each."""
    stored = table(spark, d, "events")
    arriving = as_items(as_evidence(spark.readStream.schema(stored.schema).parquet(f"{d}/events.parquet*")))
    return groups.latest(drained(groups.live_groups(arriving), "stream-groups", "append"))


QUERIES = {f.__name__: f for f in (merge_history, group_at_version, lineage_after_merges, stream_groups)}

#: All groups of a claim as lists by number, changed event by event; -1 is a group that hasn't been merged.
MERGED = f"""{EV}, x AS (
  SELECT claim, seq, k % {GROUPS} AS g, CASE WHEN status = 'click' AND k % 3 = 0 THEN (k // {GROUPS}) % {GROUPS} END AS t, CASE WHEN status = 'click' AND k % 3 = 0 THEN 'merge' WHEN action = 'withdraw' THEN 'withdraw' ELSE 'admit' END AS action,
         row_number() OVER (PARTITION BY claim ORDER BY seq) AS n FROM e
), run(claim, n, vs, ms, tos, seq, action, h, t, outcome) AS (
  SELECT DISTINCT claim, 0::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0], [0::BIGINT, 0, 0, 0, 0, 0, 0], [-1, -1, -1, -1, -1, -1, -1], NULL::BIGINT, NULL::VARCHAR, NULL::INT, NULL::INT, NULL::VARCHAR FROM e
  UNION ALL
  SELECT claim, n, list_transform(vs, lambda v, i: CASE WHEN outcome = 'merged' AND i IN (h + 1, t + 1) THEN v + 1 WHEN i = h + 1 AND outcome IN ('new', 'again', 'withdrawn') THEN v + 1 ELSE v END),
         list_transform(ms, lambda m, i: CASE WHEN outcome = 'merged' THEN CASE i WHEN h + 1 THEN 0 WHEN t + 1 THEN m + ms[h + 1] ELSE m END WHEN i <> h + 1 OR action = 'merge' THEN m WHEN action = 'admit' THEN m + 1 WHEN outcome = 'withdrawn' THEN m - 1 ELSE m END),
         list_transform(tos, lambda o, i: CASE WHEN outcome = 'merged' AND i = h + 1 THEN t ELSE o END), seq, action, h, t, outcome
  FROM (
    SELECT *, CASE WHEN action = 'merge' THEN CASE WHEN h = t THEN 'self' WHEN ms[h + 1] = 0 OR ms[t + 1] = 0 THEN 'inactive' ELSE 'merged' END
      WHEN action = 'admit' THEN CASE WHEN ms[h + 1] > 0 THEN 'admitted' WHEN vs[h + 1] = 0 THEN 'new' ELSE 'again' END WHEN ms[h + 1] > 0 THEN 'withdrawn' ELSE 'none' END AS outcome
    FROM (
      SELECT *, CASE WHEN action = 'merge' OR h5 < 0 THEN g ELSE h5 END AS h FROM (
        SELECT r.claim, x.n, vs, ms, tos, x.seq, x.action, x.t, x.g, CASE WHEN tos[x.g + 1] < 0 THEN x.g ELSE tos[x.g + 1] END AS h0, CASE WHEN tos[h0 + 1] < 0 THEN h0 ELSE tos[h0 + 1] END AS h1, CASE WHEN tos[h1 + 1] < 0 THEN h1 ELSE tos[h1 + 1] END AS h2,
               CASE WHEN tos[h2 + 1] < 0 THEN h2 ELSE tos[h2 + 1] END AS h3, CASE WHEN tos[h3 + 1] < 0 THEN h3 ELSE tos[h3 + 1] END AS h4, CASE WHEN tos[h4 + 1] < 0 THEN h4 ELSE tos[h4 + 1] END AS h5
        FROM run r JOIN x ON x.claim = r.claim AND x.n = r.n + 1
      )
    )
  )
), past AS (
  SELECT claim, seq, action, 'g' || h AS "group", nullif(vs[h + 1], 0) AS version, ms[h + 1] AS members, CASE WHEN outcome = 'merged' THEN 'g' || t END AS "into", outcome FROM run WHERE n > 0
  UNION ALL SELECT claim, seq, action, 'g' || t, vs[t + 1], ms[t + 1], NULL, outcome FROM run WHERE outcome = 'merged'
), edge AS (SELECT claim, "group" AS a, "into" AS b, seq FROM past WHERE "into" IS NOT NULL)"""
#: Where a group's items are at a time, by one merge after another.
HELD = """, climb(claim, g, upto, h) AS (
  SELECT claim, g, upto, g FROM asked UNION ALL SELECT c.claim, c.g, c.upto, e.b FROM climb c JOIN edge e ON e.claim = c.claim AND e.a = c.h AND e.seq <= c.upto
), held AS (SELECT c.* FROM climb c WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.claim = c.claim AND e.a = c.h AND e.seq <= c.upto))"""

ORACLES = {
    "merge_history": f"WITH RECURSIVE {MERGED} SELECT * FROM past",
    "group_at_version": f"""WITH RECURSIVE {MERGED}, every AS (SELECT claim, 'g' || g AS g, unnest([seq, seq + 500, 4611686018427387904]) AS upto FROM x), asked AS (SELECT DISTINCT * FROM every){HELD}
      SELECT claim, g AS "group", upto, h AS holder, count(*) AS events FROM every JOIN held USING (claim, g, upto) WHERE upto < 1000000000000 OR g <> h GROUP BY ALL""",
    "lineage_after_merges": f"""WITH RECURSIVE {MERGED}, asked AS (SELECT DISTINCT claim, 'g' || g AS g, 4611686018427387904 AS upto FROM x){HELD}
      SELECT claim, calculation, string_agg(h, '+' ORDER BY h) AS lineage FROM (SELECT DISTINCT claim, seq // 10 AS calculation, h FROM x JOIN held USING (claim) WHERE held.g = 'g' || x.g) GROUP BY ALL""",
}
ORACLES["stream_groups"] = claim_queries.ORACLES["reconcile_groups"]
