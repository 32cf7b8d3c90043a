import re

import numpy as np

from sparktap.llm import linear, spans, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op2_toxicity(spark, sf).collect()
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    hits, toxic = sum(a and b for a, b in held), sum(a for a, _ in held)
    assert hits >= 0.8 * toxic and sum(b for _, b in held) - hits <= 0.02 * len(held)


def gold(votes, share, given):
    return np.where(given == -1, np.nan, given)


def test_labels_come_from_the_voters(spark):
    """Given labels alone, on the labelled rows only, in place of the posteriors of all rows give another model."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = docs.where(linear.held_out("doc_id", 5, 0))
    out = {}
    for name, other in (("model", None), ("gold", gold)):
        model = toxicity.train(docs, labels, posteriors=other)
        out[name] = {r.doc_id: int(r.score >= 0.5) for r in toxicity.score(held, model).collect() if known.get(r.doc_id) is not None}
    held_known = out["model"]
    hits = {k: sum(p == known[i] for i, p in v.items()) for k, v in out.items()}
    for k, v in out.items():
        print(k, hits[k], len(v), sum(p and known[i] for i, p in v.items()), sum(known[i] for i in v), sum(p and not known[i] for i, p in v.items()))
    assert out["model"] != out["gold"] and hits["model"] >= 0.98 * len(held_known)


def one_kind(rates, alarms=0.01, n=4000, share=0.2, seed=1, labelled=0.3):
    """Texts, voters that fire in toxic ones with these rates, and labels of some of the texts (-1: none)."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < share
    votes = (rng.random((n, len(rates))) < np.where(y[:, None], rates, alarms)).astype(int)
    return votes, y, np.where(rng.random(n) < labelled, y, -1)


def test_one_and_two_voters_go_by_labelled_rates():
    votes, y, given = one_kind([0.95])
    for v in (votes, np.column_stack([votes, votes, votes])):  # copies of a voter are one voter
        post, stats = toxicity.toxic_posterior(v, given, 0.2)
        assert [len(g) for g in stats["small"]] == [1]
        assert (post >= 0.5)[y].mean() > 0.93 and (post >= 0.5)[~y].mean() < 0.02
        # Bayes with the planted rates.
        assert abs(post[votes[:, 0] == 1].mean() - 0.95 * 0.2 / (0.95 * 0.2 + 0.01 * 0.8)) < 0.03
    votes, y, given = one_kind([0.7, 0.7])
    post, _ = toxicity.toxic_posterior(votes, given, 0.2)
    assert (post >= 0.5)[y].mean() > 0.88 and (post >= 0.5)[~y].mean() < 0.03
    post, stats = toxicity.toxic_posterior(np.zeros((50, 2), int), np.full(50, -1), 0.2)
    assert np.allclose(post, 0.2) and not stats["small"]


def test_a_kind_of_two_voters_beside_a_large_one():
    """Eight voters of one kind, two of another that they never meet."""
    rng = np.random.default_rng(8)
    n = 6000
    kind = rng.choice(3, n, p=[0.8, 0.1, 0.1])
    rates = np.array([[0.01] * 10, [0.5] * 8 + [0.01] * 2, [0.01] * 8 + [0.8] * 2])
    votes = (rng.random((n, 10)) < rates[kind]).astype(int)
    given = np.where(rng.random(n) < 0.3, kind > 0, -1)
    post, stats = toxicity.toxic_posterior(votes, given, 0.2)
    assert [g.tolist() for g in stats["small"]] == [[8, 9]]
    for k in (1, 2):
        assert (post >= 0.5)[kind == k].mean() > 0.85
    assert (post >= 0.5)[kind == 0].mean() < 0.03


def planted(n=6000, share=0.2, seed=0):
    """Texts of two kinds of toxicity, each with eight voters of known accuracy; two voters are copies of another."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < share
    kind = rng.integers(0, 2, n)
    fire = np.array([[0.5, 0.6, 0.4, 0.7, 0.5, 0.6, 0.4, 0.5]] * 2)
    votes = np.zeros((n, 16), int)
    for k in range(2):
        on = (y & (kind == k))[:, None]
        votes[:, 8 * k : 8 * k + 8] = rng.random((n, 8)) < np.where(on, fire[k], 0.01)
    return np.column_stack([votes, votes[:, 0], votes[:, 0]]), y, kind, fire


def test_label_model_finds_accuracies_without_labels():
    votes, y, kind, fire = planted()
    states, found = toxicity.label_model(votes)
    assert states.shape[1] == 3 and abs(found["share"][1:].sum() - 0.2) < 0.02
    assert ((states[:, 1:].sum(1) > 0.5) == y).mean() > 0.98
    for k in range(2):
        own = found["accuracy"][1:, 8 * k : 8 * k + 8]
        assert np.abs(own[own.sum(1).argmax()] - fire[k]).max() < 0.1
    assert np.abs(found["accuracy"][0] - 0.01).max() < 0.01


def test_copies_of_a_voter_hang_together_and_count_once():
    votes, y, _, _ = planted()
    states, found = toxicity.label_model(votes)
    tied = {(i, int(p)) for i, p in enumerate(found["parent"]) if p >= 0}
    group = {0, 16, 17}
    assert sum(a in group and b in group for a, b in tied) == 2 and len(tied) <= 4
    few = votes.sum(1) == 3  # nothing but the copied voter fires in these
    few &= votes[:, 0] == 1
    alone = toxicity.posterior(votes.astype(float), np.full(18, -1), toxicity.chances(votes.astype(float), states, np.full(18, -1)), found["share"])
    assert states[few, 1:].sum(1).max() < 0.5 < alone[few, 1:].sum(1).min()


def test_posterior_against_plain_python():
    """Every factor of the model, text by text."""
    rng = np.random.default_rng(4)
    votes = (rng.random((50, 6)) < 0.4).astype(float)
    states = rng.dirichlet([1, 1, 1], 50)
    parent = np.array([-1, 0, 0, 2, -1, 4])
    chance = toxicity.chances(votes, states, parent)
    share = np.array([0.5, 0.3, 0.2])
    got = toxicity.posterior(votes, parent, chance, share)
    for t in range(50):
        odds = []
        for k in range(3):
            p = share[k]
            for i in range(6):
                on = int(parent[i] >= 0 and votes[t, parent[i]])
                rows = [r for r in range(50) if int(parent[i] >= 0 and votes[r, parent[i]]) == on]
                prior = (sum(states[r, k] * votes[r, i] for r in range(50)) + 1) / (sum(states[:, k]) + 2)
                c = (sum(states[r, k] * votes[r, i] for r in rows) + 2 * prior) / (sum(states[r, k] for r in rows) + 2)
                p *= c if votes[t, i] else 1 - c
            odds.append(p)
        assert np.allclose(got[t], np.array(odds) / sum(odds))


def test_scores_against_plain_python(spark, sf_small):
    """Each text's words and beginnings by a dictionary, for words of letters."""
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = [r.text for r in docs.limit(40).collect()] + ["", "IDIOT! idiots 12", "é ÀB c"]
    at = {int(c): float(w) for c, w in zip(model["columns"], model["weights"])}
    got = toxicity.scores(texts, model)
    for text, score in zip(texts, got):
        small = text.lower().encode()
        words = re.findall(rb"[A-Za-z\x80-\xff]+", small)
        counts = {}
        for w in words:
            for k, part in enumerate([w, *[w[:n] for n in toxicity.BEGINNINGS if len(w) >= n]]):
                h = plain_hash(part)
                if k:
                    h = plain_mix((h + toxicity.BEGINNINGS.index(len(part)) + 1) & M)
                col = h >> (64 - toxicity.BITS)
                counts[col] = counts.get(col, 0) + 1
        z = sum(at.get(c, 0.0) * np.log1p(200 * n / (len(words) + 100)) for c, n in counts.items()) + model["bias"]
        kinds = [sum(c.isascii() and c.isupper() for c in text), sum(c in "!?" for c in text), sum(c in "0123456789" for c in text)]
        kinds += [sum(c.isascii() and c.isprintable() and not c.isalnum() and c not in " !?" for c in text), text.count("\n")]
        shown = [n / max(1, len(text.encode())) for n in kinds] + [1 / (1 + len(words) / 20)]
        z += float(np.dot(shown, model["patterns"]))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


M = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def plain_hash(part):
    total = sum((b + 1) * pow(spans.BASE, i, 1 << 64) for i, b in enumerate(part))
    return plain_mix((total + len(part) * 0xD6E8FEB86659FD93) & M)


def test_an_id_with_two_labels_has_the_larger(spark):
    docs = spark.createDataFrame([(i, "vile word " if i % 2 else "fine word ") for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    once = spark.createDataFrame(labels, "doc_id long, toxic int")
    twice = spark.createDataFrame([(i, 0) for i, _ in labels] + labels, "doc_id long, toxic int").repartition(7)
    score = lambda x: {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, x)).collect()}
    assert score(once) == score(twice)


def test_nulls_without_labels_and_columns(spark):
    d = spark.createDataFrame([(1, None, "s"), (2, "", None), (None, "You IDIOT!!", "s"), (2, "x " * 50000, "t")], "doc_id long, text string, score string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(d, empty) is None
    assert [r.score for r in toxicity.score(d, None).collect()] == [0.0] * 4
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "vile word " if i % 2 else "fine word ") for i in range(40)], "doc_id long, text string")
    model = toxicity.train(docs, labels)
    assert toxicity.keep_rows(d, model).columns == d.columns
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(40))
    assert toxicity.score(d.limit(0), model).count() == 0


def test_regression_matches_separable_data():
    x = linear.Dense(np.array([[1.0, 0.0], [0.0, 1.0]] * 20))
    w, b = linear.fit(x, np.array([1.0, 0.0] * 20), np.ones(40), 0.01)
    assert w[0] > 1 and w[1] < -1
