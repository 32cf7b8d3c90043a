"""Process forest, entry and exit pairs, and joins with process events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_HOPS = 16


def roots(tree: DataFrame, registered: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """Rows (pid, root_pid): the nearest registered ancestor within so many hops, itself included; else the pid itself.

    By doubling: a table of what is found within n steps, and where they end, joined with itself gives 2 n steps, so 16
    hops take four equi-joins, and a cycle ends as any chain does.
    """
    own = registered.select(F.col("pid").alias("r")).distinct()
    one = tree.select("pid", "ppid").join(own, F.col("pid") == F.col("r"), "left").select("pid", F.when(F.col("ppid") > 0, F.col("ppid")).alias("next"), F.col("r").alias("root"))

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        after = second.select(F.col("pid").alias("at"), F.col("next").alias("next2"), F.col("root").alias("root2"))
        return first.join(after, F.col("next") == F.col("at"), "left").select("pid", F.col("next2").alias("next"), F.coalesce("root", "root2").alias("root"))

    out, power, left = None, one, hops
    while left:
        if left & 1:
            out = power if out is None else then(out, power)
        left >>= 1
        if left:
            power = then(power, power)
    return out.select("pid", F.coalesce("root", "pid").alias("root_pid"))


def monitored(tree: DataFrame, registered: DataFrame, hops: int = 8) -> DataFrame:
    """Pids that are registered or have a registered ancestor within so many hops; all where none is registered."""
    found = roots(tree, registered, hops + 1).join(registered.select(F.col("pid").alias("root_pid")), "root_pid", "left_semi").select("pid")
    return found if not registered.isEmpty() else tree.select("pid")


def children(tree: DataFrame) -> DataFrame:
    return tree.where("ppid > 0").groupBy("ppid").agg(F.count(F.lit(1)).alias("n_children"), F.min("pid").alias("first_child"), F.max("pid").alias("last_child"))


def paired(calls: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """Exits whose previous row of the same key is an entry, with that entry's columns; an entry is used once."""
    w = W.partitionBy(key).orderBy(*order)
    seen = calls.withColumns({"prev_entry": F.lag("is_entry").over(w), **{f"entry_{c}": F.lag(c).over(w) for c in carry}})
    return seen.where(~F.col("is_entry") & F.col("prev_entry")).drop("prev_entry", "is_entry")


def after_first_seen(events: DataFrame, ssl: DataFrame) -> DataFrame:
    """Process events of pids that an earlier TLS event has registered."""
    first = ssl.groupBy("pid").agg(F.min("timestamp_ns").alias("since"))
    return events.join(first, "pid").where(F.col("timestamp_ns") >= F.col("since")).drop("since")


def resolved_paths(writes: DataFrame, opens: DataFrame) -> DataFrame:
    """Each write with the path that its (pid, fd) was last opened with: an as-of join by one sort of both sides."""
    both = opens.select("pid", "fd", "timestamp_ns", F.lit(0).alias("side"), F.col("path").alias("opened"), F.lit(None).cast("long").alias("event_id")).unionByName(writes.select("pid", "fd", "timestamp_ns", F.lit(1).alias("side"), F.lit(None).cast("string").alias("opened"), "event_id"))
    w = W.partitionBy("pid", "fd").orderBy("timestamp_ns", "side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("resolved_path", F.last("opened", ignorenulls=True).over(w)).where("side = 1").select("event_id", "pid", "fd", "timestamp_ns", "resolved_path")


def tree_at(events: DataFrame, now_ns: int) -> DataFrame:
    """The process table at a time, by one grouping: rows (pid, ppid, comm, exited_ns, is_root).

    Events have pid, ppid, comm, timestamp_ns and kind: `register` makes a pid a root, and a node where there is none;
    `exec` puts a new node in the place of the old one; `exit` marks the node and takes the pid from the roots. Of events
    at the same time, an exec comes first and an exit last. Pids with nothing but exits have no node.
    """
    kind = F.col("kind")
    when = lambda k, c: F.when(kind == k, F.col(c))
    rank = F.when(kind == "exec", 0).when(kind == "register", 1).otherwise(2)
    order = F.struct("timestamp_ns", rank)
    rooted = F.max_by(kind, F.when(kind.isin("register", "exit"), order)) == "register"
    each = events.where((F.col("timestamp_ns") <= now_ns) & kind.isin("register", "exec", "exit")).groupBy("pid").agg(
        F.max(F.when(kind == "exec", F.struct("timestamp_ns", "ppid", "comm"))).alias("node"),
        F.min(F.when(kind == "register", F.struct("timestamp_ns", F.lit(0).cast("long").alias("ppid"), "comm"))).alias("root"),
        F.max(when("exit", "timestamp_ns")).alias("exited_ns"), F.coalesce(rooted, F.lit(False)).alias("is_root"),
    )
    found = each.withColumn("n", F.coalesce("node", "root")).where(F.col("n").isNotNull())
    exited = F.when(F.col("exited_ns") >= F.col("n.timestamp_ns"), F.col("exited_ns"))
    return found.select("pid", "n.ppid", "n.comm", exited.alias("exited_ns"), "is_root")


def collected(nodes: DataFrame, now_ns: int, keep_ns: int = 300_000_000_000) -> DataFrame:
    """The table without nodes that ended longer ago than the limit."""
    return nodes.where(F.col("exited_ns").isNull() | (F.col("exited_ns") >= now_ns - keep_ns))


def snapshot(nodes: DataFrame) -> DataFrame:
    """The nodes (pid, ppid, more) with their children's pids, ascending, empty for none. A process has as many children as
    the kernel has pids at most (4 million), so a list is bounded; no row's list is made twice."""
    lists = nodes.where("ppid IS NOT NULL").groupBy("ppid").agg(F.array_sort(F.collect_set("pid")).alias("children")).withColumnRenamed("ppid", "__parent")
    joined = nodes.join(lists, F.col("pid") == F.col("__parent"), "left").drop("__parent")
    return joined.withColumn("children", F.coalesce("children", F.array().cast(lists.schema["children"].dataType)))
