"""Joins that keep texts and hot keys where they are: rows taken away by id, and rows named by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktap.session import materialise

#: Ids up to this number may be broadcast (8 bytes each); above it they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The documents, with all their columns, whose id isn't in ids (one column); a null id stays."""
    gone = materialise(ids.toDF("__gone").where(F.col("__gone").isNotNull()).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col] == gone["__gone"], "left_anti")


def join_named(rows: DataFrame, named: DataFrame, key: str, uses: str, total: int, how: str = "inner") -> DataFrame:
    """The rows with the columns of `named`, which has one row for each key and how often the key is used. how: "left"
    keeps rows whose key has no name, with nulls; a null key has none.

    A key with over a thousandth of all uses (and over 1000) is hot: there are 1000 such keys at most, so they are
    broadcast and their rows stay where they are. All others are joined by shuffle.
    """
    hot = F.col(uses) > max(1000, total // 1000)
    few, many = named.where(hot).drop(uses), named.where(~hot).drop(uses)
    by_few = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return by_few.unionByName(rest.join(many, key, how))


def join_salted(rows: DataFrame, named: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """The rows with the columns of `named`, which has one row for each key. A key of over a thousandth of all `total` rows
    (and over 1000) is dealt out by the column `other` to as many parts, each with a copy of the key's row: there are 2000
    copies at most, and nothing but the names of these keys is broadcast."""
    most = max(1000, total // 1000)
    if total <= most:
        return rows.join(named, key)
    hot = rows.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__uses")).where(F.col("__uses") > most)
    hot = F.broadcast(hot.select("__hot", F.ceil(F.col("__uses") / most).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(other), parts).cast("int")).drop("__hot", "__parts")
    right = named.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__hot", "__parts")
    return left.join(right, [key, "__salt"]).drop("__salt")
