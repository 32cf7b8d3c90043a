import re
from collections import defaultdict
from itertools import permutations

import numpy as np

from sparktap.llm import filter_audit as A


def failing(text, smaller):
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    out = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
    return out + "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * smaller


def brute(rows, labels):
    """Follow each document through each order."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = [(s or "", failing(t or "", i is not None and first[t or ""] < i), *[any(x[0] == i and i is not None and x[c] == 1 for x in labels) for c in (1, 2)]) for i, t, s in rows]
    out, shapley = {}, defaultdict(int)
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            total = sum(1 for d in left)
            for step, k in enumerate(order, 1):
                gone = [d for d in left if k in d[1]]
                fails = [d for d in docs if d[0] == part and k in d[1]]
                left = [d for d in left if k not in d[1]]
                total -= len(gone)
                shapley[part, k] += len(gone)
                out[part, "".join(order), step] = [total, len(gone), len(fails) - len(gone), sum(d[1] == k for d in fails), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    got = [((r.part, r.filter_order, r.step), (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def fixture():
    rng = np.random.default_rng(3)
    plain = " ".join(f"w{k}" for k in range(60))
    kinds = [None, "", "few words", plain, "W " * 60, plain + " #", "UPPER " + plain.upper(), plain + "\x0b x y", "x" * 40000 + " $", "\U0001F600" * 10 + "A"]
    rows = [(int(i) if i % 11 else None, kinds[rng.integers(len(kinds))], [None, "", "a", "b", "hot"][min(4, rng.integers(9))]) for i in range(1, 120)]
    rows += [(5, plain, "hot"), (5, plain, "hot"), (-1, plain, "a")]
    labels = [(int(i), [None, 0, 1][rng.integers(3)], [None, 0, 1][rng.integers(3)]) for i in rng.integers(1, 120, 90)] + [(None, 1, 1)]
    return rows, labels


def test_equals_following_each_document(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, part int, n string")
    named = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    want = brute(rows, labels)
    assert collected(A.audit(A.flags(docs, named))) == want
    bare = collected(A.audit(A.flags(docs)))
    assert bare == {k: (*v[:4], 0, 0, v[6]) for k, v in want.items()}
    assert A.audit(A.flags(docs.limit(0), named)).count() == 0


def test_hot_text_and_all_parts_together(spark, monkeypatch):
    from sparktap.llm import keep

    rows, labels = fixture()
    rows += [(1000 + i, "the very same text", f"s{i % 3}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flagged = A.flags(docs, named)
    assert flagged.where("E").count() >= 1499
    both = collected(A.audit(flagged, total=True))
    each = {k: v for k, v in both.items() if k[0] is not None}
    assert each == brute(rows, labels)
    for (part, order, step), v in both.items():
        if part is None:
            assert v == tuple(map(sum, zip(*[x for k, x in each.items() if k[1:] == (order, step)])))
