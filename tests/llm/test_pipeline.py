import re
from collections import defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from sparktap.llm import toxicity
from sparktap.session import materialise

from tests.llm.brute import groups

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_small), f"test-{name}"))
    return out


def test_columns_stay(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:-1])
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "packing"]


def test_toxicity_stage(stages, spark, sf_small):
    """The stage keeps exactly the texts that score below a half, one by one."""
    before, after = rows(stages[0]), rows(stages[1])
    model = toxicity.train(stages[0], spark.read.parquet(f"{sf_small}/labels.parquet"))
    assert set(after) == {i for i, r in before.items() if toxicity.scores([r.text or ""], model)[0] < 0.5}
    assert all(after[i] == before[i] for i in after)


def odd_rows(spark, docs):
    """Nulls, empty, long and repeated rows, and columns whose names the stages use themselves."""
    text = docs.first().text
    odd = [(-1, None), (-2, ""), (-3, text.upper()), (None, text), (-4, "word " * 60_000), (-5, "one"), (-5, "one"), (-6, "password=Zq7wrtyu9opasd2fg")]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    return docs.unionByName(d).selectExpr("*", "1 AS id", "2 AS key", "3 AS __t", "'x' AS component_id", "4 AS sha", "5 AS kept")


def test_stages_with_odd_rows_and_clashing_columns(spark, sf_small):
    docs = odd_rows(spark, spark.read.parquet(f"{sf_small}/documents.parquet").limit(30))
    for name, stage in C.STAGES[:-1]:
        out = materialise(stage(spark, docs, sf_small), f"odd-{name}")
        assert out.dtypes == docs.dtypes and out.where("id <> 1 OR kept <> 5").count() == 0
        docs = out
    left = {r.doc_id: r.text for r in docs.collect()}
    assert (-1 in left) != (-2 in left) or -1 in left
    assert left[-6] == "[SECRET]" and -4 in left
    assert C.STAGES[-1][1](spark, docs, sf_small).where("doc_id = -4").agg({"length": "sum"}).first()[0] >= 60_000


def test_empty_tables(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        docs = materialise(stage(spark, docs, sf_small), f"none-{name}")
        assert docs.count() == 0


def test_exact_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    best = {}
    for i, r in before.items():
        best[(r.text or "").translate(UP)] = max(i, best.get((r.text or "").translate(UP), i))
    assert set(after) == set(best.values()) and all(after[i] == before[i] for i in after)


def test_near_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    comp, _ = groups({i: r.text for i, r in before.items()}, 80)
    assert set(after) == set(comp.values())


def test_secret_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        if "[SECRET]" in r.text:
            assert re.fullmatch(r"(?s).+".join(map(re.escape, r.text.split("[SECRET]"))), before[i].text)
        else:
            assert r == before[i]


def test_packing_stage(stages):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows(stages[4]).items()}
    got = defaultdict(int)
    for r in stages[5].collect():
        got[r.doc_id] += r.length
    assert got == want
