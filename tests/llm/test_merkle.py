import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from sparktap.llm import merkle as M


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(level, fanout):
    """All levels, and for each leaf its runs: (run, place)."""
    paths, levels = [[] for _ in level], [level]
    at = list(range(len(level)))
    while len(levels[-1]) > 1:
        now = levels[-1]
        runs = [now[i : i + fanout] for i in range(0, len(now), fanout)]
        for p, i in zip(paths, at):
            p.append((runs[i // fanout], i % fanout))
        at = [i // fanout for i in at]
        levels.append([H("".join(r)) for r in runs])
    return levels[-1][0], paths, levels


def brute(rows, fanout):
    """rows: doc_id, source, lang, n_chars, text."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    parts = {k: tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])], fanout) for k in langs}
    root, over, _ = tree([parts[k][0] for k in langs], fanout)
    out = []
    for k, up in zip(langs, over):
        for (_, _, h, r), path in zip(sorted(by[k], key=lambda x: x[:3]), parts[k][1]):
            whole = path + up
            proof = H("".join("".join(run[:i] + run[i + 1 :]) for run, i in whole))
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1 if bad and r[3] is not None else r[3], r[4]))
            for run, i in whole:
                now = H("".join(run[:i]) + now + "".join(run[i + 1 :]))
            out.append((r[0], h, parts[k][0], root, proof, now, now == root))
    return Counter(out)


def made(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice([None, "", "en", "en", "en", "en", "é", "zz", f"l{rng.randrange(6)}"])
        rows.append((rng.choice([None, rng.randrange(n), i]), rng.choice([None, "", "s1", "ü"]), lang, rng.choice([None, 0, 7, 2**63 - 1, -5]), rng.choice([None, "", "x", "\U0001F600" * 3, "long " * 9000])))
    return rows + rows[:5]


SHOWN = "doc_id long, source string, lang string, n_chars long, text string, leaf string, at int"


def proofs(spark, rows, parts, **options):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], SHOWN).repartition(parts)
    drawn = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    m = M.Manifest(d, tampered={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, where=drawn, **options)
    return m, Counter(tuple(r) for r in m.proofs().collect())


@pytest.mark.parametrize("n,fanout,span,parts", [(150, 2, 2, 7), (90, 3, 1, 3), (1, 2, 10, 1)])
def test_proofs_equal_brute_force(spark, n, fanout, span, parts):
    rows = made(spark, n, n)
    if n == 1:
        rows = rows[:1]
    m, got = proofs(spark, rows, parts, fanout=fanout, span=span)
    assert got == brute(rows, fanout)
    # The records are each inner node once.
    by = defaultdict(list)
    for r in rows:
        by["" if r[2] is None else "=" + r[2]].append((r[0] is not None, r[0] or 0, leaf(r)))
    want = Counter((k, lv, i, h) for k, x in by.items() for lv, hs in enumerate(tree([y[2] for y in sorted(x)], fanout)[2]) if lv for i, h in enumerate(hs))
    assert Counter((r.key, r.level, r.at, r.digest) for r in m.parts.nodes.collect()) == want


def test_empty_table(spark):
    m, got = proofs(spark, [], 1)
    assert m.root is None and not got


def test_peaks_of_any_cuts_merge_to_the_same_tree():
    rng = random.Random(4)
    for size, fanout in [(1, 2), (2, 2), (37, 2), (64, 2), (100, 3), (81, 3), (50, 7)]:
        values = [H(str(i)) for i in range(size)]
        root, _, levels = tree(values, fanout)
        cuts = [0, *sorted(rng.sample(range(1, size), min(size - 1, rng.randrange(6)))), size]
        left, nodes = [], []
        for a, b in zip(cuts, cuts[1:]):
            r = M.MountainRange(size, fanout)
            for i in range(a, b):
                nodes += r.push(0, i, values[i])
            left += r.left()
        if len(cuts) > 2:
            r = M.MountainRange(size, fanout)
            for level, at, value, kind in left:
                assert kind == M.PEAK
                nodes += r.push(level, at, value)
            left = list(r.left())
        assert left == [(len(levels) - 1, 0, root, M.TOP)]
        assert sorted(nodes) == sorted((lv, i, h) for lv, hs in enumerate(levels) if lv for i, h in enumerate(hs))
