"""Operators over time: interval joins by root, ancestry while pids are reused, registration of roots, anchored rates.

None of them needs an order over all rows in one task: times are dealt into buckets, chains are followed by doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktap.session import materialise, release

#: Ends of an interval that is open.
FIRST_NS, LAST_NS = -(1 << 63), (1 << 63) - 1


def correlate(left: DataFrame, right: DataFrame, before_ns: int, after_ns: int, key: str = "root_pid", left_time: str = "timestamp_ns", right_time: str = "timestamp_ns") -> DataFrame:
    """All pairs of a left and a right row of the same key where the right one lies in [t - before, t + after] of the left
    one: columns of the left side as they are, those of the right side with the prefix `right_`.

    Both sides are dealt out by key and time bucket, as wide as the interval, so a left row meets two buckets and a busy key
    is parted by time. Rows without a key or a time have no partner.
    """
    width = before_ns + after_ns + 1
    exact = lambda t: F.expr(f"(({t}) - pmod({t}, {width}L)) div {width}L")
    l_rows = left.where(F.col(left_time).isNotNull()).withColumn("__b", F.explode(F.array_distinct(F.array(exact(f"{left_time} - {before_ns}L"), exact(f"{left_time} + {after_ns}L")))))
    r_rows = right.where(F.col(right_time).isNotNull()).select(F.col(key).alias("__k"), exact(right_time).alias("__rb"), *[F.col(c).alias(f"right_{c}") for c in right.columns])
    close = F.col(f"right_{right_time}").between(F.col(left_time) - before_ns, F.col(left_time) + after_ns)
    return l_rows.join(r_rows, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__rb")) & close).drop("__b", "__k", "__rb", f"right_{key}")


def correlate_streams(left: DataFrame, right: DataFrame, before_ns: int, after_ns: int, late: str = "10 seconds", key: str = "root_pid") -> DataFrame:
    """The pairs of correlate() as a join of two streams. Each side is kept until the other's watermark has passed its
    interval; rows later than `late`, and all of times before 1970, are dropped by Spark. Times are compared to the nanosecond."""
    at = lambda d, c: d.withColumn(c, F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark(c, late)
    l_rows = at(left, "__lt")
    r_rows = at(right, "__rt").select(F.col(key).alias("__k"), "__rt", *[F.col(c).alias(f"right_{c}") for c in right.columns if c != key])
    # The wide bounds, in whole microseconds, tell Spark how long state is kept.
    micros = lambda ns: F.expr(f"INTERVAL {-(-ns // 1000) + 1} MICROSECONDS")
    wide = (F.col("__rt") >= F.col("__lt") - micros(before_ns)) & (F.col("__rt") <= F.col("__lt") + micros(after_ns))
    close = F.col("right_timestamp_ns").between(F.col("timestamp_ns") - before_ns, F.col("timestamp_ns") + after_ns)
    return l_rows.join(r_rows, (F.col(key) == F.col("__k")) & wide & close).drop("__lt", "__rt", "__k")


#: A bucket of correlated() is so many intervals wide: fewer rows stand in two buckets, and a busy key is still parted by time.
WIDE = 4


def correlated(http: DataFrame, ssl: DataFrame, proc: DataFrame, before_ns: int, after_ns: int) -> DataFrame:
    """One row per http event: event_id, root_pid, and of the TLS and the process events of its root near it their number and
    the nearest one (ties: the earlier, then the lesser id). The three have event_id, root_pid and timestamp_ns.

    No pair is made: the others are dealt to the buckets of root and time in which they may be near an http event, and one
    sort of a bucket counts them up to both ends of each event's interval and shows those next to its time.
    """
    cols = ["event_id", "root_pid", "timestamp_ns"]
    width = WIDE * (before_ns + after_ns + 1)
    bucket = lambda ns: F.expr(f"((timestamp_ns + {ns}L) - pmod(timestamp_ns + {ns}L, {width}L)) div {width}L")
    known = lambda d: d.select(*cols).where("root_pid IS NOT NULL AND timestamp_ns IS NOT NULL")
    # What lies nearest is next to the event's time, or to the interval's end on its side.
    marks = [-before_ns - 1, min(max(0, -before_ns), after_ns), after_ns]
    asked = known(http).withColumns({"kind": F.lit("http"), "b": bucket(0)})
    other = known(ssl).withColumn("kind", F.lit("ssl")).unionByName(known(proc).withColumn("kind", F.lit("proc")))
    other = other.withColumn("b", F.explode(F.array_distinct(F.array(bucket(-after_ns), bucket(before_ns)))))
    rows = asked.unionByName(other).repartition("root_pid", "b")
    is_asked = F.col("kind") == "http"
    rows = rows.select("*", F.posexplode(F.when(is_asked, F.array(*[F.col("timestamp_ns") + n for n in marks])).otherwise(F.array("timestamp_ns"))).alias("mark", "at"))
    w = W.partitionBy("root_pid", "b").orderBy("at", is_asked, F.col("event_id").asc_nulls_last())
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = {}
    for k in ("ssl", "proc"):
        here = F.col("kind") == k
        # Of equal times the least id is the last: its bits are turned.
        seen[f"n_{k}"] = F.count_if(here).over(so_far)
        seen[f"last_{k}"] = F.max(F.when(here, F.struct(F.col("at").alias("at"), F.bitwise_not("event_id").alias("turned")))).over(so_far)
        seen[f"next_{k}"] = F.expr(f"lead(CASE WHEN kind = '{k}' THEN struct(at, event_id) END) IGNORE NULLS OVER (PARTITION BY root_pid, b ORDER BY at, kind = 'http', event_id NULLS LAST)")
    near, nearest, number = rows.withColumns(seen).where(is_asked), [], []
    for k in ("ssl", "proc"):
        gap = lambda at, i: F.when((F.col("mark") == 1) & at.between(F.col("timestamp_ns") - before_ns, F.col("timestamp_ns") + after_ns), F.struct(F.abs(at - F.col("timestamp_ns")).alias("gap"), at.alias("at"), i.alias("id")))
        number.append(F.sum(F.when(F.col("mark") == 2, F.col(f"n_{k}")).when(F.col("mark") == 0, -F.col(f"n_{k}"))).alias(f"n_{k}"))
        nearest.append(F.min(F.least(gap(F.col(f"last_{k}.at"), F.bitwise_not(F.col(f"last_{k}.turned"))), gap(F.col(f"next_{k}.at"), F.col(f"next_{k}.event_id")))).alias(f"near_{k}"))
    # By bucket first, where the rows are.
    near = near.groupBy("root_pid", "b", "event_id").agg(*number, *nearest)
    near = near.groupBy("event_id").agg(*[f(c).alias(c) for k in ("ssl", "proc") for f, c in ((F.sum, f"n_{k}"), (F.min, f"near_{k}"))])
    out = http.select("event_id", "root_pid").join(near, "event_id", "left")
    return out.select("event_id", "root_pid", *[c for k in ("ssl", "proc") for c in (F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}"), F.col(f"near_{k}.id").alias(f"nearest_{k}"))])


def segments(events: DataFrame) -> DataFrame:
    """The state of each pid over time, rows (pid, low, high, next, root), times in [low, high).

    events: pid, timestamp_ns, kind, ppid. `exec` gives the pid a new node below ppid, `register` makes it a root, `exit` and
    `deregister` end that; the node stays in the tree until the next exec. Of events at the same time an exec comes first
    and an end last; of several execs the largest ppid counts. next: the parent (none: null); root: the pid while it is a
    registered root. Each pid, parents without events too, is covered from the first to the last time.
    """
    ppid = F.max(F.when(F.col("kind") == "exec", F.col("ppid")))
    ends = F.max(F.when(F.col("kind").isin("exit", "deregister"), 0))
    begins = F.max(F.when(F.col("kind") == "register", 1))
    each = events.where("pid IS NOT NULL AND timestamp_ns IS NOT NULL").groupBy("pid", F.col("timestamp_ns").alias("low")).agg(ppid.alias("ppid"), F.coalesce(ends, begins).alias("on"))
    known = each.select("pid").union(each.select("ppid").where("ppid > 0")).distinct()
    start = known.select("pid", F.lit(FIRST_NS).cast("long").alias("low"), F.lit(None).cast("long").alias("ppid"), F.lit(0).alias("on"))
    order = W.partitionBy("pid").orderBy("low")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    state = start.unionByName(each).select(
        "pid", "low", F.coalesce(F.lead("low").over(order), F.lit(LAST_NS)).alias("high"), F.last("ppid", ignorenulls=True).over(so_far).alias("ppid"), F.last("on", ignorenulls=True).over(so_far).alias("on")
    )
    return state.select("pid", "low", "high", F.when(F.col("ppid") > 0, F.col("ppid")).alias("next"), F.when(F.col("on") == 1, F.col("pid")).alias("root"))


def ancestry(states: DataFrame, hops: int = 16) -> DataFrame:
    """The nearest registered ancestor within so many hops, itself included, over time: rows (pid, low, high, root).

    By doubling, as for a tree that stands still: a table of 2**k hops, joined with itself where the end of the one is the
    start of the other and their times overlap, gives 2**(k + 1). A walk ends at a root, so a cycle ends as any walk does.
    """
    made = []

    def kept(d: DataFrame) -> DataFrame:
        made.append(materialise(d, "ancestry"))
        return made[-1]

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        after = second.select(F.col("pid").alias("at"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("next").alias("next2"), F.col("root").alias("root2"))
        on = first.where("next IS NOT NULL")
        met = on.join(after, (F.col("next") == F.col("at")) & (F.col("low2") < F.col("high")) & (F.col("high2") > F.col("low")))
        met = met.select("pid", F.greatest("low", "low2").alias("low"), F.least("high", "high2").alias("high"), F.when(F.col("root2").isNull(), F.col("next2")).alias("next"), F.col("root2").alias("root"))
        return kept(first.where("next IS NULL").unionByName(met))

    one = kept(states.withColumn("next", F.when(F.col("root").isNull(), F.col("next"))))
    out, power, left = None, one, hops
    while left:
        if left & 1:
            out = power if out is None else then(out, power)
        left >>= 1
        if left:
            power = then(power, power)
    release(*[m for m in made if m is not out])
    return out.drop("next")


def as_of(events: DataFrame, states: DataFrame, value: str) -> DataFrame:
    """The events (pid, timestamp_ns, more) with the value that held for their pid at their time: one sort of both."""
    extra = [c for c in events.columns if c not in ("pid", "timestamp_ns")]
    kind = states.schema[value].dataType
    point = states.select("pid", F.col("low").alias("timestamp_ns"), F.lit(0).alias("__side"), F.struct(F.col(value).alias("v")).alias("__v"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in extra])
    asked = events.select("pid", "timestamp_ns", F.lit(1).alias("__side"), F.lit(None).cast(point.schema["__v"].dataType).alias("__v"), *extra)
    w = W.partitionBy("pid").orderBy("timestamp_ns", "__side").rowsBetween(W.unboundedPreceding, 0)
    found = point.unionByName(asked).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return found.select("pid", "timestamp_ns", *extra, F.col("__v.v").cast(kind).alias(value))


def roots_over_time(events: DataFrame, lives: DataFrame, hops: int = 16) -> DataFrame:
    """The events with root_pid: the nearest root above their pid at their time, or the pid itself."""
    return as_of(events, ancestry(segments(lives), hops), "root").withColumn("root_pid", F.coalesce("root", "pid")).drop("root")


def captured_over_time(events: DataFrame, lives: DataFrame, hops: int = 8) -> DataFrame:
    """The events of pids that are roots or have one within so many hops at that time; before the first registration of
    any, all events. With the last root gone nothing is captured: the filter stays on."""
    found = as_of(events, ancestry(segments(lives), hops + 1), "root")
    since = lives.where("kind = 'register'").agg(F.min("timestamp_ns")).first()[0]
    early = F.lit(True) if since is None else F.col("timestamp_ns") < since
    return found.where(F.col("root").isNotNull() | early).drop("root")


def registrations(ssl: DataFrame, ended: DataFrame) -> DataFrame:
    """Events of roots: a TLS event registers its pid, rows (pid, timestamp_ns) of `ended` deregister theirs."""
    row = lambda d, k: d.select("pid", "timestamp_ns", F.lit(k).alias("kind"), F.lit(None).cast("long").alias("ppid"))
    return row(ssl, "register").unionByName(row(ended, "deregister"))


#: Time buckets in a group, within which the next one that isn't empty is looked for first.
GROUP = 1024


def anchored_rates(events: DataFrame, width_ns: int = 10_000_000_000, time: str = "timestamp_ns") -> DataFrame:
    """Rates over windows that the events themselves end: rows (start_ns, end_ns, n, rate) of closed windows.

    A window starts at the event that ended the one before, the first at the first event; the first event that lies width
    or more after the start ends it and counts in it. Of events at the same time one ends the window, the others belong
    to the next. Each time knows the time that would end its window; which times do start one is found by doubling.
    """
    bucket = F.expr(f"({time} - pmod({time}, {width_ns}L)) div {width_ns}L")
    times = materialise(events.where(F.col(time).isNotNull()).groupBy(F.col(time).alias("t"), bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")), "times")
    # The next bucket that has events, and its first time: inside a group of buckets, else in the groups after.
    firsts = times.groupBy("b").agg(F.min("t").alias("t")).withColumn("g", F.expr(f"(b - pmod(b, {GROUP}L)) div {GROUP}L"))
    groups = firsts.groupBy("g").agg(F.min(F.struct("b", "t")).alias("head"))
    # One row for each GROUP * width of time, whatever happens in it.
    groups = groups.withColumn("after", F.lead("head").over(W.orderBy("g"))).select("g", "after")
    nexts = firsts.withColumn("in", F.lead(F.struct("b", "t")).over(W.partitionBy("g").orderBy("b"))).join(groups, "g")
    nexts = materialise(nexts.select("b", F.coalesce("in", "after").alias("to")), "buckets")
    second = nexts.select(F.col("b").alias("b2"), F.col("to").alias("to2"))
    beyond = nexts.join(second, F.col("b2") == F.col("to.b"), "left").select("b", F.when(F.col("to.b") > F.col("b") + 1, F.col("to.t")).otherwise(F.col("to2.t")).alias("beyond"))
    # In bucket b + 1, the first time at or after t + width; from the end, so that a running value does.
    both = times.select("b", "t", F.col("t").alias("event"), F.lit(None).cast("long").alias("start")).union(times.select(F.col("b") + 1, F.col("t") + width_ns, F.lit(None).cast("long"), F.col("t")))
    w = W.partitionBy("b").orderBy(F.desc("t"), F.col("event").isNull()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("to", F.last("event", ignorenulls=True).over(w)).where("start IS NOT NULL").select((F.col("b") - 1).alias("b"), F.col("start").alias("t"), "to")
    jump = materialise(found.join(beyond, "b").select("t", F.coalesce("to", "beyond").alias("to")).where("to IS NOT NULL"), "jumps")
    ends = jump.select(F.col("t").alias("start_ns"), F.col("to").alias("end_ns"))
    t0 = times.agg(F.min("t")).first()[0]
    chain = materialise(times.where(F.col("t") == t0).select("t"), "chain")
    steps, size, power = [jump], 0, jump
    while (now := chain.count()) > size:
        size = now
        more = materialise(chain.union(chain.join(power, "t").select(F.col("to").alias("t"))).distinct(), "chain")
        release(chain)
        chain = more
        power = materialise(power.join(power.select(F.col("t").alias("at"), F.col("to").alias("to2")), F.col("to") == F.col("at")).select("t", F.col("to2").alias("to")), "jumps")
        steps.append(power)
    release(*steps[1:])
    windows = chain.join(ends, F.col("t") == F.col("start_ns")).select("start_ns", "end_ns")
    # All other times of a window lie in the bucket of its start or the next one.
    own = F.expr(f"(start_ns - pmod(start_ns, {width_ns}L)) div {width_ns}L")
    met = windows.withColumn("b", F.explode(F.array(own, own + 1))).join(times, "b").where("t >= start_ns AND t < end_ns")
    sums = met.groupBy("start_ns", "end_ns").agg(F.sum("n").alias("n"))
    out = sums.withColumn("n", F.col("n") + (F.col("start_ns") == t0).cast("long"))
    return out.withColumn("rate", F.col("n") / ((F.col("end_ns") - F.col("start_ns")) / F.lit(1e9)))
