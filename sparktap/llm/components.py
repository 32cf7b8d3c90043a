"""Connected components of an edge table, by alternating large and small stars.

Nothing is collected: each step is a minimum for each vertex, combined map-side, and a join of the edges with it. A
vertex with a thousandth of all edges or more is a hub: there are 2000 hubs at most, so their minima are broadcast and
their edges stay where they are; all others are joined by shuffle. The loop ends when a step changes nothing.

Defined results: edges of a vertex with itself and repeated edges change nothing; an edge with a null end must not be
given. An empty edge table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparktap.session import materialise, release

#: Edges of a vertex that are dealt to one task in any case.
LEAST_HUB = 1000


def _with_minima(edges: DataFrame, own: bool, hub: int) -> DataFrame:
    """The edges (a, b) with m, the least b of their a; where `own`, a itself counts too."""
    m = F.least("a", F.min("b")) if own else F.min("b")
    least = edges.groupBy("a").agg(m.alias("m"), F.count(F.lit(1)).alias("c")).withColumnRenamed("a", "v")
    hubs = F.broadcast(least.where(F.col("c") > hub).select("v", "m"))
    marked = edges.join(hubs, F.col("a") == F.col("v"), "left").drop("v")
    rest = least.where(F.col("c") <= hub).select("v", F.col("m").alias("rest_m"))
    others = marked.where("m IS NULL").join(rest, F.col("a") == F.col("v")).select("a", "b", F.col("rest_m").alias("m"))
    return marked.where("m IS NOT NULL").select("a", "b", "m").union(others)


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_minima(both, True, hub).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    tied = _with_minima(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False, hub)
    ends = F.explode(F.array(F.col("a"), F.col("b")))
    return tied.select(ends.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """The edges as a table, and their number and combined hash, seen while they are written."""
    seen = Observation()
    table = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), name)
    return table, seen.get


def contracted(edges: DataFrame, steps: int | None = None, least_hub: int = LEAST_HUB) -> DataFrame:
    """A table of edges (a, b), b < a, with the same components; without a limit of steps each vertex but the least of its
    component is linked with that one only."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, state = _written(now, "edges")
    while state["n"] and steps != 0:
        hub = max(least_hub, state["n"] // 1000)
        new, then = _written(_small_star(_large_star(now, hub), hub), "stars")
        release(now)
        now, state, before = new, then, state
        steps = steps and steps - 1
        if state == before:
            break
    return now


def components(edges: DataFrame, least_hub: int = LEAST_HUB) -> DataFrame:
    """Rows (id, component) of all vertices in edges (a, b) but the least of each component, whose label it is."""
    now = contracted(edges, None, least_hub)
    out = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out.table_path = now.table_path
    return out
