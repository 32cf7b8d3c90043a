import numpy as np
import pytest

from sparktap.llm import ngram_join as J
from tests.llm.brute import groups
from tests.llm.test_near_dedup import variants


def check(d, texts, num, **options):
    comp, n = groups(texts, num, options.get("width", 4))
    out = J.ngram_join(d, num=num, **options).collect()
    assert len(out) == d.count()
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (n[r.doc_id], comp[r.doc_id]), r
    return comp


def test_whole_table_against_brute_force(spark, sf_mid):
    d = spark.read.parquet(f"{sf_mid}/documents.parquet")
    comp = check(d, {r.doc_id: r.text for r in d.collect()}, 85)
    assert sum(i != c for i, c in comp.items()) > 20


def test_chains_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    texts, now = [], [f"w{k}" for k in range(200)]
    for k in range(40):  # each like the last, the ends unlike
        now[rng.integers(0, 200)] = f"x{k}"
        texts.append(" ".join(now))
    texts += ["", None, "one two", "ONE  two", "one two three", texts[3].upper(), "w " * 3000, " ".join(f"v{k % 7000}" for k in range(30000)), " ".join(f"v{k % 7001}" for k in range(30000))]
    data = [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 2), (3, texts[3], 3)]
    d = spark.createDataFrame(data, "doc_id long, text string, component_id int")
    check(d, {i: t for i, t, _ in data if i is not None}, 85)
    assert J.ngram_join(d.limit(0)).count() == 0


@pytest.mark.parametrize("bits,block", [(18, 1024), (2, 5)])
def test_pairs_near_the_threshold(spark, monkeypatch, bits, block):
    """Any order of the columns and any size of blocks give the same links."""
    product = J.block_product
    monkeypatch.setattr(J, "block_product", lambda rows, num, den: product(rows, num, den, block))
    texts = variants(np.random.default_rng(5), 60)
    half = " ".join(f"h{k}" for k in range(100))
    texts += [half + " " + " ".join(f"u{i}_{k}" for k in range(100)) for i in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(d, dict(enumerate(texts)), 85, bits=bits)


def test_one_leader_of_many_near_copies(spark):
    """More than a thousand partners of one row: its set is dealt out."""
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base + [f"x{i}"]) for i in range(1300)] + ["other " * 3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.ngram_join(d, num=85).collect()}
    assert got == {i: 0 if i < 1300 else i for i in range(1301)}


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(2)
    for _ in range(100):
        x, y = (np.unique(rng.integers(0, 2000, rng.integers(0, 3000)).astype(np.uint64)) for _ in range(2))
        a, b = J.odd_sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_first_columns_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        shared = rng.integers(0, 1 << 60, n, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 60, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(2))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            firsts = [set(np.sort(v)[: J.first_columns(len(v), 85, 100)].tolist()) for v in (x, y)]
            assert firsts[0] & firsts[1]


def test_a_block_product_against_plain_python():
    """Columns that a row has twice, rows of one component, sizes too far apart."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    reps = {r: (int(rng.integers(3)), int(rng.integers(8, 12))) for r in range(20)}
    for twice in (False, True):
        entries = []
        for r, (comp, n) in reps.items():
            for pos, key in enumerate(sorted(rng.choice(12, n, replace=twice).tolist())):
                entries.append((key, r, comp, n, pos))
        rows = [(0, int(e[2] != 0), *e) for e in entries if e[2]] + [(1, int(e[2] != 0), *e) for e in entries]
        # As if each row had so many columns in other matrices that no bound applies.
        rows = [(*r, 100) for r in rows]
        names = ["side", "minor", "key", "rep", "comp", "n", "pos", "of"]
        got = J._product(85, 100)(pa.table({c: pa.array([r[i] for r in rows]) for i, c in enumerate(names)}))
        want = {}
        for k1, r1, c1, n1, p1 in entries:
            for k2, r2, c2, n2, p2 in entries:
                if k1 == k2 and r1 < r2 and c1 != c2 and 100 * min(n1, n2) >= 85 * max(n1, n2):
                    c, a, b = want.get((r1, r2), (0, 0, 0))
                    want[r1, r2] = (c + 1, max(a, p1), max(b, p2))
        assert {(r["a"], r["b"]): (r["c"], r["pa"], r["pb"]) for r in got.to_pylist()} == want
        assert all((r["na"], r["nb"]) == (reps[r["a"]][1], reps[r["b"]][1]) for r in got.to_pylist())
