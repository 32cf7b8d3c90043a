"""Toxicity by weak supervision.

Voters are words and word beginnings that stand out in labelled toxic texts (lexicon), and surface patterns such as
capitals and exclamation marks. They vote on labelled and unlabelled texts alike. A generative label model takes the state
of a text for hidden: clean, or one of the kinds of toxic text, which groups of voters that fire together suggest. In a
state each voter fires with a chance of its own (its accuracy), and where voters depend on each other beyond what the state
explains, it fires with another chance if the voter that it hangs on has fired (its correlations: a forest of the strongest
significant dependencies). Chances, shares and forest come from the voters' agreement by expectation maximisation; given
labels take no part in it: they choose the voters and, in the end, say which states are toxic. One voter, or two that fire
together with no other, show no agreement that accuracies could be read from: the accuracy of such small kinds is their
rate in the labelled texts of each class, of toxic ones as far as no state explains them. A text is toxic by a state or by
a small kind. A linear classifier of all words and word beginnings is trained on the posterior
labels of all these texts; it scores every text.

The training sample is bounded by MOST_PER_CLASS and MOST_ROWS (labelled texts) and MOST_UNLABELLED; label counts cover
all learning rows. Counts of columns are made on the executors, and only chosen columns (MOST_COLUMNS) come to the driver.
Defined results: null and empty text get the score of the bias; without labels of both classes every score is 0. A null
toxic label teaches nothing; an id that repeats in the labels has the largest of its labels; rows that repeat an id are
scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktap.llm import linear, spans
from sparktap.session import materialise, release, ship

MOST_PER_CLASS = 4000
MOST_ROWS = 8000
MOST_UNLABELLED = 8000
MOST_VOTERS = 160
#: Columns of the classifier, those that differ most between the labelled classes.
MOST_COLUMNS = 1 << 16
#: Standard errors by which a voter's column is more frequent in labelled toxic texts.
VOTER_Z = 3.0
#: A dependency of two voters counts where its likelihood ratio is larger; of pairs of independent voters, one in ten
#: million reaches it (chi-squared, 2 degrees of freedom).
DEPENDENT = 32.0
#: Correlation of voters that belong to one kind of toxic text.
TOGETHER = 0.2
#: Correlation of voters that are copies of each other, as those of a word and of its beginning often are.
SAME = 0.9
BITS = 20
#: Columns whose shares in the two classes differ by less, in standard errors, are left out of the classifier.
LEAST_Z = 1.5
#: Bytes of a word that its beginnings have.
BEGINNINGS = (4, 6, 8)
N_PATTERNS = 6
BREAKS = np.array([not (chr(b).isascii() and chr(b).isalpha() or b >= 0x80) for b in range(256)])


def _lower(text: str, raw: bytes) -> bytes:
    """In small letters; of A-Z only where that would change the length."""
    small = text.lower().encode()
    return small if len(small) == len(raw) else raw.lower()


def features(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of texts: low, high, text number and hash of each word and beginning, words in each text, patterns."""
    raw = [x.encode() for x in texts]
    for low, high in spans.blocks([len(x) for x in raw]):
        joined = b" ".join(raw[low:high])
        codes = np.frombuffer(joined, np.uint8)
        offsets = np.cumsum([0, *[len(x) + 1 for x in raw[low:high]]])
        small = np.frombuffer(b" ".join(map(_lower, texts[low:high], raw[low:high])), np.uint8)
        starts, ends = spans.word_spans(small, BREAKS)
        sums = spans.prefix(small)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        n_words = np.bincount(owner, minlength=high - low)
        rows, hashes = [owner], [spans.span_hashes(sums, starts, ends)]
        for k, n in enumerate(BEGINNINGS):
            long = ends - starts >= n
            s = starts[long]
            rows.append(owner[long])
            hashes.append(spans.mix(spans.span_hashes(sums, s, s + n) + spans.U(k + 1)))
        yield low, high, np.concatenate(rows), (np.concatenate(hashes) >> spans.U(64 - BITS)).astype(np.int64), n_words, _patterns(codes, offsets, n_words)


def _patterns(codes: np.ndarray, offsets: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Shares of capitals, exclamation and question marks, digits, other marks, lines, and short texts."""
    kinds = np.zeros(256, np.int8)
    kinds[65:91] = 1
    kinds[[33, 63]] = 2
    kinds[48:58] = 3
    kinds[[*range(34, 48), *range(58, 63), 64, *range(91, 97), *range(123, 127)]] = 4
    kinds[10] = 5
    own = kinds[codes]
    sizes = np.maximum(np.diff(offsets) - 1, 1)
    out = np.zeros((len(n_words), N_PATTERNS))
    for k in range(1, 6):
        sums = np.concatenate([[0], np.cumsum(own == k)])
        ends = np.minimum(offsets[1:], len(codes))
        out[:, k - 1] = (sums[ends] - sums[np.minimum(offsets[:-1], len(codes))]) / sizes
    out[:, 5] = 1.0 / (1 + n_words / 20)
    return out


def _rate(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.log1p(200.0 * counts / (n_words + 100.0))


def _grouped(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts = np.unique((rows.astype(np.int64) << BITS) | hashes, return_counts=True)
    return keys >> BITS, keys & (1 << BITS) - 1, counts


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, columns, vals, patterns) from rows (label, text)."""
    for batch in spans.slices(batches):
        label = batch.column(0)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for low, high, rows, hashes, n_words, patterns in features(texts):
            r, h, c = _grouped(rows, hashes)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=high - low))])
            values = _rate(c, n_words[r]).astype(np.float32)
            split = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
            cols = [label.slice(low, high - low), split(h.astype("<i4")), split(values), pa.array([x.tobytes() for x in patterns], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["label", "columns", "vals", "patterns"])


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (col, toxic, clean): in how many labelled texts of each class a column occurs, summed up for the task."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for label, raw in zip(batch.column("label").to_pylist(), batch.column("columns").to_pylist()):
            if label is not None:
                counts[label, np.frombuffer(raw, "<i4")] += 1
    some = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])], names=["col", "toxic", "clean"])


def _chosen(columns: np.ndarray):
    """Keeps the entries of chosen columns, numbered by their place among them (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[columns] = np.arange(len(columns))
        for batch in batches:
            cols, vals = [], []
            for c, v in zip(batch.column("columns").to_pylist(), batch.column("vals").to_pylist()):
                at = place[np.frombuffer(c, "<i4")]
                cols.append(at[at >= 0].astype("<i4").tobytes())
                vals.append(np.frombuffer(v, "<f4")[at >= 0].tobytes())
            kept = [batch.column("label"), pa.array(cols, pa.binary()), pa.array(vals, pa.binary()), batch.column("patterns")]
            yield pa.RecordBatch.from_arrays(kept, names=["label", "columns", "vals", "patterns"])

    return run


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in a binary column, end to end, and how many each row has."""
    parts = [(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1], c.buffers()[2]) for c in column.chunks if len(c)]
    flat = [np.frombuffer(data, kind, (o[-1] - o[0]) // 4, o[0]) if data is not None else np.zeros(0, kind) for o, data in parts]
    return np.concatenate(flat), np.concatenate([np.diff(o) // 4 for o, _ in parts])


def _pair_counts(votes: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Expected counts [state, vote of i, vote of j, i, j] under the posterior of the states (texts x states)."""
    out = np.empty((states.shape[1], 2, 2, votes.shape[1], votes.shape[1]))
    for k, w in enumerate(states.T):
        both = (votes * w[:, None]).T @ votes
        own = w @ votes
        out[k, 1, 1] = both
        out[k, 1, 0] = own[:, None] - both
        out[k, 0, 1] = own[None] - both
        out[k, 0, 0] = w.sum() - own[:, None] - own[None] + both
    return np.maximum(out, 0)


def dependencies(votes: np.ndarray, states: np.ndarray, least: float = DEPENDENT) -> tuple[np.ndarray, np.ndarray]:
    """The voter that each voter hangs on (-1: none), and the likelihood ratios of dependence given the state.

    The forest is that of the largest ratios (Kruskal); ratios up to `least` don't count.
    """
    n = _pair_counts(votes, states) + 1e-9
    total, rows, cols = n.sum((1, 2), keepdims=True), n.sum(2, keepdims=True), n.sum(1, keepdims=True)
    ratio = 2 * (n * np.log(n * total / (rows * cols))).sum((0, 1, 2))
    np.fill_diagonal(ratio, 0)
    m = votes.shape[1]
    group, near = list(range(m)), [[] for _ in range(m)]
    a, b = np.triu_indices(m, 1)
    for e in np.argsort(-ratio[a, b], kind="stable"):
        i, j = int(a[e]), int(b[e])
        if ratio[i, j] <= least:
            break
        if _root(group, i) != _root(group, j):
            group[_root(group, i)] = _root(group, j)
            near[i].append(j), near[j].append(i)
    parent, seen = np.full(m, -1), set()
    for top in range(m):
        stack = [] if top in seen else [top]
        seen.update(stack)
        while stack:
            i = stack.pop()
            for j in near[i]:
                if j not in seen:
                    seen.add(j)
                    parent[j] = i
                    stack.append(j)
    return parent, ratio


def _root(group: list[int], i: int) -> int:
    while group[i] != i:
        group[i] = group[group[i]]
        i = group[i]
    return i


def correlations(votes: np.ndarray) -> np.ndarray:
    centred = votes - votes.mean(0)
    spread = np.sqrt((centred**2).sum(0))
    return centred.T @ centred / np.outer(spread, spread)


def kinds(phi: np.ndarray, least: float = TOGETHER, size: int = 3) -> list[np.ndarray]:
    """Groups of voters that fire in the same texts: those linked by a correlation of at least so much."""
    m = len(phi)
    group = list(range(m))
    for i, j in zip(*np.nonzero(np.triu(phi >= least, 1))):
        group[_root(group, int(i))] = _root(group, int(j))
    roots = np.array([_root(group, i) for i in range(m)])
    return [found for r in np.unique(roots) if len(found := np.flatnonzero(roots == r)) >= size]


def chances(votes: np.ndarray, states: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Of each state, vote of the parent (0 where there is none), and voter: the chance to fire."""
    on = np.where(parent >= 0, votes[:, parent], 0)
    out = np.empty((states.shape[1], 2, votes.shape[1]))
    for k, w in enumerate(states.T):
        fire = (w @ votes + 1) / (w.sum() + 2)
        for v in (0, 1):
            here = w[:, None] * (on == v)
            # Where the parent was seen like that rarely, a voter fires as it does in its state.
            out[k, v] = ((here * votes).sum(0) + 2 * fire) / (here.sum(0) + 2)
    return out


def posterior(votes: np.ndarray, parent: np.ndarray, chance: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Chances of the states (texts x states) given the votes."""
    on = np.where(parent >= 0, votes[:, parent], 0)
    score = np.empty((len(votes), len(share)))
    for k in range(len(share)):
        p = np.where(on == 1, chance[k, 1], chance[k, 0])
        score[:, k] = np.log(share[k]) + np.log(np.where(votes == 1, p, 1 - p)).sum(1)
    out = np.exp(score - score.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def label_model(votes: np.ndarray, steps: int = 40) -> tuple[np.ndarray, dict]:
    """Posterior chances of the hidden states (texts x states) from the votes (texts x voters, 0 or 1) alone.

    State 0 is where voters fire by chance only; each other one starts from a group of voters that fire together.
    """
    votes = np.asarray(votes, float)
    votes = votes[:, (votes.mean(0) > 0) & (votes.mean(0) < 1)]
    if not votes.size:
        return np.ones((len(votes), 1)), {"accuracy": np.zeros((1, 0)), "parent": np.zeros(0, int), "share": np.ones(1)}
    # Voters that fire as an earlier one does say nothing new: a text starts as toxic if two others agree.
    phi = correlations(votes)
    first = np.flatnonzero(~(np.triu(phi, 1) >= SAME).any(0))
    groups = [first[g] for g in kinds(phi[np.ix_(first, first)])] or [first]
    fired = np.column_stack([votes[:, g].sum(1) for g in groups])
    states = np.full((len(votes), len(groups) + 1), 0.01)
    states[np.arange(len(votes)), np.where(fired.max(1) >= 2, fired.argmax(1) + 1, 0)] = 1.0
    states /= states.sum(1, keepdims=True)
    parent = np.full(votes.shape[1], -1)
    for step in range(steps):
        if step % 10 == 0:
            parent, _ = dependencies(votes, states)
        chance = chances(votes, states, parent)
        share = np.maximum(states.mean(0), 1e-6)
        states = posterior(votes, parent, chance, share / share.sum())
    fire = (states.T @ votes + 1) / (states.sum(0)[:, None] + 2)
    return states, {"accuracy": fire, "chance": chance, "parent": parent, "share": states.mean(0), "votes": votes}


def voter_kinds(votes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Voters whose kind has three different ones or more, with the copies of these, and the other kinds without copies."""
    use = np.flatnonzero((votes.mean(0) > 0) & (votes.mean(0) < 1)) if len(votes) else np.zeros(0, int)
    if not len(use):
        return use, []
    phi = correlations(votes[:, use].astype(float))
    first = np.flatnonzero(~(np.triu(phi, 1) >= SAME).any(0))
    all_ = [first[g] for g in kinds(phi[np.ix_(first, first)], size=1)]
    small = [g for g in all_ if len(g) < 3]
    lone = np.concatenate(small) if small else np.zeros(0, int)
    copies = (phi[lone] >= SAME).any(0) if len(lone) else np.zeros(len(use), bool)
    return use[~copies], [use[g] for g in small]


def anchored(votes: np.ndarray, small: list[np.ndarray], given: np.ndarray, unexplained: np.ndarray, share: float) -> np.ndarray:
    """Chance that a text is toxic in a way that small kinds show. Of a kind's votes taken together, their share among
    labelled toxic texts, as far as these are unexplained, stands against that among labelled clean ones, each with two
    texts of the overall share added."""
    weight = np.where(given == 1, unexplained, given == 0)
    left = weight[given == 1].mean() if (given == 1).any() else 1.0
    odds = np.full(len(votes), np.log(np.clip(share * left, 1e-9, 1) / (1 - share)))
    for g in small:
        seen = votes[:, g].astype(int) @ (1 << np.arange(len(g)))
        at = [np.bincount(seen[given == c], weight[given == c], minlength=1 << len(g)) for c in (0, 1)]
        overall = (at[0] + at[1] + 1e-9) / (at[0] + at[1] + 1e-9).sum()
        rate = [(x + 2 * overall) / (x.sum() + 2) for x in at]
        odds += np.log(rate[1] / rate[0])[seen]
    return linear.sigmoid(odds)


def toxic_posterior(votes: np.ndarray, given: np.ndarray, share: float) -> tuple[np.ndarray, dict]:
    """Chance that each text is toxic. given: 1 toxic, 0 clean, -1 unlabelled; share: that of toxic labels."""
    agreeing, small = voter_kinds(votes)
    p, stats = np.zeros(len(votes)), {"small": small}
    if len(agreeing):
        states, found = label_model(votes[:, agreeing])
        # The voters don't know the states' names: labelled texts tell which of them are toxic.
        toxic = [k for k in range(states.shape[1]) if states[given == 1, k].sum() > states[given == 0, k].sum()]
        p, stats = states[:, toxic].sum(1), stats | found
    if small or not len(agreeing):
        p = 1 - (1 - p) * (1 - anchored(votes, small, given, 1 - p, share))
    return np.clip(p, 0, 1), stats


def lexicon_votes(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, z: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Votes (texts x voters) of the columns that tell labelled toxic texts best. A voter fires where its column's rate in
    a text reaches a bound of its own: that of the three tried (any, the median and the upper quartile of toxic texts that
    have it) with which it tells the labelled classes best."""
    tried = np.argsort(-z, kind="stable")[: 2 * MOST_VOTERS]
    tried = tried[z[tried] > VOTER_Z]
    at = np.full(len(z), -1)
    at[tried] = np.arange(len(tried))
    mine = at[cols] >= 0
    rate = np.zeros((len(given), len(tried)), np.float32)
    rate[rows[mine], at[cols[mine]]] = values[mine]
    toxic, clean = rate[given == 1], rate[given == 0]
    best, bound = np.full(len(tried), -np.inf), np.zeros(len(tried), np.float32)
    some = np.where(toxic > 0, toxic, np.nan)
    for limit in (np.zeros(len(tried), np.float32), np.nanquantile(some, 0.5, axis=0), np.nanquantile(some, 0.75, axis=0)) if len(tried) else ():
        limit = np.maximum(limit, 1e-6).astype(np.float32)
        p1, p0 = (toxic >= limit).mean(0), (clean >= limit).mean(0)
        p = (p1 * len(toxic) + p0 * len(clean)) / (len(toxic) + len(clean))
        here = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / len(toxic) + 1 / len(clean)) + 1e-9)
        bound, best = np.where(here > best, limit, bound), np.maximum(best, here)
    chosen = np.argsort(-best, kind="stable")[:MOST_VOTERS]
    chosen = chosen[best[chosen] > VOTER_Z]
    return (rate[:, chosen] >= bound[chosen]).astype(np.int8)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn=None, posteriors=None) -> dict | None:
    """The model: hashed columns and their weights, pattern weights, bias. None where labels of a class are missing.

    learn: condition on `__id` of the rows to learn from. posteriors: another function of (votes, share, given labels
    with -1 for none) than the label model, for comparisons; texts for which it gives NaN teach nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    learn = learn if learn is not None else ~linear.held_out("__id", 5, 0)
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__label in (0, 1)")
    known = known.where(learn).where("__id IS NOT NULL").groupBy("__id").agg(F.max("__label").alias("__label"))
    shares = {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
    if len(shares) < 2:
        return None
    chosen = linear.sample_by_class(known, "__label", "__id", MOST_PER_CLASS, MOST_ROWS)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__id IS NOT NULL")
    # Texts for the voters only: a bounded sample of the rows to learn from, drawn by a hash; those with labels vote once.
    total = rows.where(learn).count()
    drawn = F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, MOST_UNLABELLED / max(total, 1)) * (1 << 30))
    joined = rows.where(learn).join(F.broadcast(chosen), "__id", "left").where(F.col("__label").isNotNull() | drawn)
    shown = "label int, columns binary, vals binary, patterns binary"
    table = materialise(joined.select("__label", "__text").mapInArrow(_extract, shown), "voted")
    try:
        return _fitted(table, shares, posteriors)
    finally:
        release(table)


def _fitted(table: DataFrame, shares: dict, posteriors) -> dict | None:
    sizes = {r[0]: r[1] for r in table.where("label IS NOT NULL").groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return None
    uses = table.mapInArrow(_uses, "col long, toxic long, clean long").groupBy("col").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p = (F.col("toxic") + F.col("clean")) / float(n1 + n0)
    z = (F.col("toxic") / float(n1) - F.col("clean") / float(n0)) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
    uses = uses.withColumn("z", z).where((F.col("toxic") + F.col("clean") >= 3) & (F.abs("z") >= LEAST_Z))
    best = uses.orderBy(F.desc(F.abs("z")), "col").limit(MOST_COLUMNS).select("col", "z").toArrow()
    order = np.argsort(best.column("col").to_numpy())
    kept, z = best.column("col").to_numpy()[order].astype(np.int64), best.column("z").to_numpy()[order]
    found = table.mapInArrow(_chosen(kept), "label int, columns binary, vals binary, patterns binary").toArrow()
    given = np.array([-1 if x is None else x for x in found.column("label").to_pylist()])
    n = len(given)
    flat, counts = _flat(found.column("columns"), "<i4")
    values, _ = _flat(found.column("vals"), "<f4")
    patterns = np.array([np.frombuffer(x) for x in found.column("patterns").to_pylist()]).reshape(n, N_PATTERNS)
    del found
    x_rows, x_cols = np.repeat(np.arange(n), counts), flat.astype(np.int64)
    fires = lexicon_votes(x_rows, x_cols, values, z, given)
    marks = patterns > np.quantile(patterns, 0.95, axis=0)
    # A pattern votes for what it goes with in the labelled texts.
    marks = marks[:, [m for m in range(N_PATTERNS) if marks[given == 1, m].mean() > marks[given == 0, m].mean()]]
    votes = np.column_stack([fires, marks])
    share = shares[1] / (shares[0] + shares[1])
    post, stats = toxic_posterior(votes, given, share) if posteriors is None else (posteriors(votes, share, given), {})
    told = ~np.isnan(post)
    post = np.where(told, post, 0.0)
    x_rows = np.concatenate([x_rows, np.repeat(np.arange(n), N_PATTERNS)])
    x_cols = np.concatenate([x_cols, np.tile(len(kept) + np.arange(N_PATTERNS), n)])
    x = linear.Sparse(x_rows, x_cols, np.concatenate([values.astype(float), patterns.reshape(-1)]), (n, len(kept) + N_PATTERNS))
    # The classes count as often as they occur among the learning rows, whatever the sample holds of them.
    weight = told * (post * (share * n / max(post[told].sum(), 1e-9)) + (1 - post) * ((1 - share) * n / max((1 - post)[told].sum(), 1e-9)))
    w, b = linear.fit(x, post, weight, penalty=0.02)
    return {"columns": kept, "weights": w[: len(kept)].astype(np.float32), "patterns": w[len(kept) :], "bias": b, "voters": votes.shape[1], "label_model": stats}


def scores(texts: list[str], model: dict | None) -> np.ndarray:
    out = np.zeros(len(texts))
    if model is None:
        return out
    dense = np.zeros(1 << BITS, np.float32)
    dense[model["columns"]] = model["weights"]
    for low, high, rows, hashes, n_words, patterns in features(texts):
        some = dense[hashes] != 0
        r, h, c = _grouped(rows[some], hashes[some])
        z = np.bincount(r, dense[h] * _rate(c, n_words[r]), high - low) + patterns @ model["patterns"] + model["bias"]
        out[low:high] = linear.sigmoid(z)
    return out


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score) of all documents."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores([x or "" for x in batch.column(1).to_pylist()], model))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_rows(docs: DataFrame, model: dict | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns; no row is shuffled."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches):
            yield batch.filter(pa.array(scores([x or "" for x in batch.column(at).to_pylist()], model) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", linear.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
