"""Components, running sums and taking rows away, each against plain Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparktap.llm import keep
from sparktap.llm.arrays import running
from sparktap.llm.components import components


def plain_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent if root(x) != x}


def found(spark, edges, least_hub=1000):
    d = spark.createDataFrame(edges, "a long, b long")
    return {r.id: r.component for r in components(d, least_hub).collect()}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=60), st.sampled_from([2, 1000]))
def test_components(spark, edges, least_hub):
    assert found(spark, edges, least_hub) == plain_components(edges)


def test_components_of_hubs_and_chains(spark):
    hub = [(500, i) for i in range(1000, 4000)]
    chain = [(i, i + 1) for i in range(5000, 5100)]
    assert found(spark, [*hub, *chain, (7, 7)], 50) == plain_components([*hub, *chain])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 1000, 4097])
def test_running_sums(spark, n):
    numbers = [(i * 7) % 11 for i in range(n)]
    got = spark.createDataFrame([(numbers,)], "a array<int>").select(running(F.col("a")).alias("r")).first().r
    assert got == [sum(numbers[:i]) for i in range(n)]


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_rows_are_taken_away_by_broadcast_or_shuffle(spark, monkeypatch, bound):
    monkeypatch.setattr(keep, "BROADCAST_IDS", bound)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, None)], "doc_id long, __x string")
    ids = spark.createDataFrame([(2,), (None,), (2,), (9,)], "doc_id long")
    assert sorted(keep.without(docs, ids, "doc_id").collect(), key=str) == sorted([(1, "a"), (None, "d"), (3, None)], key=str)
