import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparktap.llm import exact_dedup as E
from tests.llm.brute import UP


def check(spark, rows, **how):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, keep_id string, recipe int")
    got = E.exact_dedup(d, **how).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UP), []).append(i)
    want = []
    for i, t in rows:
        norm = (t or "").translate(UP)
        ids = [x for x in groups[norm] if x is not None]
        best = max(ids) if ids else None
        want.append((str(i), str(best), len(groups[norm]), i == best, hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)


def odd_rows():
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "Beta", "gamma.", "漢字。", "É"]) for _ in range(60_000))
    texts = [None, "", "a", "A", "É", "é", "a ", long, long.lower(), long[:-1], long[1:], long + long, "\n", "x" * 20_000, "X" * 20_000]
    rows = list(enumerate(texts)) + [(3, "A"), (None, "a"), (None, "only"), (7, long), (90, long.upper())]
    return rows


@pytest.mark.parametrize("key", [
    E.chunk_key,
    lambda c: F.lit(7).cast("long"),  # every chunk collides with every other
    lambda c: F.char_length(c).cast("long"),  # some do
])
def test_against_brute_force_with_colliding_keys(spark, key):
    check(spark, odd_rows(), key=key)


def test_chunks_join_to_the_text_and_survive_a_shift(spark):
    texts = [t for _, t in odd_rows() if t]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(E.chunks(F.col("t")).alias("c"))
    found = [r.c for r in d.collect()]
    assert ["".join(c) for c in found] == texts
    assert all(len(x) <= E.MOST + 7 for c in found for x in c)
    base = texts[5]
    shifted = spark.createDataFrame([("new words first. " + base,)], "t string").select(E.chunks(F.col("t")).alias("c")).first().c
    own = set(found[5])
    assert len(own & set(shifted)) > 0.8 * len(own)


def test_empty_table_and_kept_rows(spark):
    d = spark.createDataFrame([(1, "a", 5), (2, "A", 6), (2, "A", 7), (3, None, 8)], "doc_id long, text string, gone int")
    assert E.exact_dedup(d.limit(0)).count() == 0 and E.keep_rows(d.limit(0)).count() == 0
    assert sorted(tuple(r) for r in E.keep_rows(d).collect()) == [(2, "A", 6), (2, "A", 7), (3, None, 8)]
