import numpy as np
import pytest

from sparktap.llm import near_dedup as N
from sparktap.llm import settle as S
from sparktap.llm.near_dedup import near_duplicates
from tests.llm.brute import groups


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_near_duplicates_against_brute_force(spark, sf_mid):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_mid}/documents.parquet").collect()}
    comp, n = groups(texts, 85)
    for i, r in rows(near_duplicates(spark.read.parquet(f"{sf_mid}/documents.parquet"), num=85)).items():
        assert (r.n_shingles, r.component_id, r.kept) == (n[i], comp[i], comp[i] == i)


def test_near_duplicates_of_a_chain_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(300)]
    texts, now = [], list(base)
    for k in range(60):  # each like the last, the ends unlike
        now[rng.integers(0, 300)] = f"x{k}"
        texts.append(" ".join(now))
    texts += ["", None, "one two", "ONE  two", "one two three", texts[3].upper(), "w " * 3000]
    data = [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 2), (3, texts[3], 3)]
    d = spark.createDataFrame(data, "doc_id long, text string, component_id int")
    comp, n = groups({i: t for i, t, _ in data if i is not None}, 85)
    out = near_duplicates(d, num=85).collect()
    assert len(out) == len(data)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (n[r.doc_id], comp[r.doc_id])
    assert near_duplicates(d.limit(0)).count() == 0


def variants(rng, n, words=200):
    """Texts around a common one, many of whose pairs lie near the threshold."""
    base = [f"w{k}" for k in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.choice(words, int(rng.integers(0, 5)), replace=False):
            own[at] = f"x{rng.integers(0, 1 << 30)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("sketch,block", [(True, 1024), (True, 5), (False, 1024)])
def test_pairs_near_the_threshold(spark, monkeypatch, sketch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(5)
    texts = variants(rng, 60)
    # A family of unlike members that share half their text: their buckets hold many components.
    half = " ".join(f"h{k}" for k in range(100))
    texts += [half + " " + " ".join(f"u{i}_{k}" for k in range(100)) for i in range(40)]
    for num in (85, 95):
        comp, _ = groups(dict(enumerate(texts)), num)
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {i: r.component_id for i, r in rows(near_duplicates(d, num=num, sketch=sketch)).items()}
        assert got == comp


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    n_bands = N.bands_for(0.85)
    runs, bounds = [], [0]
    for _ in range(300):
        shared = rng.integers(0, 1 << 63, 850, dtype=np.uint64)
        for _ in range(2):
            own = np.sort(np.concatenate([shared, rng.integers(0, 1 << 63, 75, dtype=np.uint64)]))
            runs.append(own)
            bounds.append(bounds[-1] + len(own))
    bands, sketches = N.signatures(np.concatenate(runs), np.array(bounds), n_bands)
    apart = np.bitwise_count(sketches[::2] ^ sketches[1::2]).sum(1)
    assert (apart <= N.most_unlike(0.85, n_bands * N.ROWS)).all()
    assert (bands[::2] == bands[1::2]).any(1).all()
