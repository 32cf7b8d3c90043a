"""Audit of how filters interact: what each filter removes at each step of each order, from one CUBE.

Each document becomes a row of failure flags. Documents are counted by part and flags (at most 2**filters cells a part),
and only those cells go through CUBE over flags and part. Of its rows, those whose selected flags are all false count the
survivors of the selected subset of filters, in any order of them. A step of an order takes one subset to the next, so
its figures come from a join of two subsets' rows; no document is read again for any of the orders.

Documents with equal texts are found by digest (SHA-256), so no text is moved: a digest that many rows share is counted
map-side, and its name is broadcast, so that its rows stay where they are.

Defined results: null text counts as empty, null part as the empty string. A row whose id is null has no smaller or
larger id: it isn't a repeat, nobody's repeat is one of it, and it has no label. Rows that repeat an id are counted each;
with equal texts none of them is the other's repeat. Of several labels of an id, any 1 counts. An empty table gives no
rows. Columns that aren't named are not read, so their names can't clash.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktap.llm.keep import join_named
from sparktap.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Filters by letter, as op11 orders them.
FILTERS = "ABCDE"


def text_failures(text: Column, least_words: int = 50, distinct_pct: int = 65, upper_pct: int = 5, marks: str = "[#$%&*|]") -> dict[str, Column]:
    """Whether a text has few words, many repeated ones, many capitals of A-Z, or any of the marks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": count < least_words, "B": 100 * distinct < distinct_pct * count, "C": 100 * upper > upper_pct * F.char_length(text), "D": text.rlike(marks)}


def flags(docs: DataFrame, labels: DataFrame | None = None, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: part, A to E (whether it fails the filter), good, toxic (whether labelled so)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = materialise(rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()]), "flags")
    named = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("uses")).where("uses > 1")
    rows = join_named(rows, named, "digest", "uses", rows.count(), "left")
    rows = rows.select("id", "part", "A", "B", "C", "D", F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("E"))
    if labels is None:
        return rows.select("part", *FILTERS, F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    marked = rows.where("id IS NOT NULL").join(known, "id", "left").unionByName(rows.where("id IS NULL"), allowMissingColumns=True)
    return marked.select("part", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


COUNTS = ("n", "good", "toxic")


def survivors(flagged: DataFrame, names: str = FILTERS, total: bool = False) -> DataFrame:
    """One row per part and subset of filters (mask: bit i for the filter names[i]), zeros included: how many documents,
    good ones and toxic ones fail none of the subset. total: also for all parts together, as part null."""
    number = lambda c: F.sum(F.col(c).cast("long"))
    cells = flagged.groupBy("part", *names).agg(F.count(F.lit(1)).alias("n"), number("good").alias("good"), number("toxic").alias("toxic"))
    cells = materialise(cells, "cells")
    # An all-false cell of no documents, so that each subset has a row where nothing survives.
    none = cells.select("part").distinct().select("part", *[F.lit(False).alias(c) for c in names], *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    cube = cells.unionByName(none).cube("part", *names).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("over"), *[F.grouping(c).alias(f"all_{c}") for c in names])
    passed = F.lit(True)
    mask = F.lit(0)
    for i, c in enumerate(names):
        passed = passed & ((F.col(f"all_{c}") == 1) | ~F.col(c))
        mask = mask + (1 - F.col(f"all_{c}").cast("int")) * (1 << i)
    return cube.where(passed if total else passed & (F.col("over") == 0)).select("part", mask.alias("mask"), *COUNTS)


def _orders(spark, names: str) -> DataFrame:
    """Every step of every order: the filter and the subset applied before it."""
    rows = []
    for order in permutations(range(len(names))):
        mask = 0
        for step, i in enumerate(order):
            rows.append(("".join(names[j] for j in order), step + 1, i, mask))
            mask |= 1 << i
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, mask int")


def audit(flagged: DataFrame, names: str = FILTERS, total: bool = False) -> DataFrame:
    """One row per part, order of the filters and step. flagged: part, a boolean column for each letter of names, good,
    toxic. There are len(names)! orders, so a few filters only."""
    k = len(names)
    every = (1 << k) - 1
    subsets = materialise(survivors(flagged, names, total), "subsets")
    before = subsets.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.expr("mask & shiftleft(1, filter) = 0"))
    before = before.withColumn("next", F.col("mask") + F.expr("shiftleft(1, filter)"))
    after = subsets.select(F.col("part").alias("p"), F.col("mask").alias("m"), F.col("n").alias("kept"), F.col("good").alias("good_kept"), F.col("toxic").alias("toxic_kept"))
    pairs = before.join(after, before["part"].eqNullSafe(after["p"]) & (before["next"] == after["m"]))
    removed = F.col("n") - F.col("kept")
    pairs = pairs.select("part", "mask", "filter", "kept", removed.alias("removed"), (F.col("good") - F.col("good_kept")).alias("good_lost"), (F.col("toxic") - F.col("toxic_kept")).alias("toxic_lost"))
    # Of all k! orders, so many have just the filters of a mask before this one.
    weight = F.element_at(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)).cast("long") for i in range(k)]), F.bit_count("mask") + 1)
    at = lambda mask: F.max(F.when(F.col("mask") == mask, F.col("removed")))
    own = pairs.groupBy("part", "filter").agg(at(0).alias("fails"), at(F.lit(every) - F.expr("shiftleft(1, filter)")).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"))
    own = own.withColumnsRenamed({"part": "p", "filter": "f"})
    each = pairs.join(own, pairs["part"].eqNullSafe(own["p"]) & (pairs["filter"] == own["f"]))
    steps = each.join(F.broadcast(_orders(flagged.sparkSession, names)), ["mask", "filter"])
    return steps.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return audit(flags(read("documents"), read("labels")))


#: Each document is followed through each step of each order.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), d AS (
  SELECT doc_id, part, {'A': len(words) < 50, 'B': 100 * list_unique(words) < 65 * len(words), 'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t),
      'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, FALSE)} AS f,
    EXISTS (FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic
  FROM w
), e AS (
  SELECT part, good, toxic, [k FOR k IN ['A', 'B', 'C', 'D', 'E'] IF CASE k WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END] AS fails FROM d
), o(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || k FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(k) WHERE NOT contains(filter_order, k)
), s AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS k, string_split(filter_order[1:step - 1], '') AS earlier FROM o, range(1, 6) r(step) WHERE len(filter_order) = 5
), c AS (
  SELECT part, filter_order, step, k, NOT list_has_any(fails, earlier) AS there, list_contains(fails, k) AS failing, fails = [k] AS only_this, good, toxic FROM e, s
), g AS (
  SELECT part, filter_order, step, k, count(*) FILTER (there AND NOT failing) AS kept, count(*) FILTER (there AND failing) AS removed, count(*) FILTER (NOT there AND failing) AS redundant,
    count(*) FILTER (only_this) AS unique_fails, count(*) FILTER (there AND failing AND good) AS good_lost, count(*) FILTER (there AND failing AND toxic) AS toxic_lost
  FROM c GROUP BY ALL
)
SELECT * EXCLUDE (k), (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM g
"""
