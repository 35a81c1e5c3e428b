import random

import numpy as np
from sweepgrid.llm import toxicity as tox


def corpus(seed=3, n=900):
    r = random.Random(seed)
    words = ["".join(r.choice(("an", "the", "or", "en", "ti", "re", "do", "el", "in")) for _ in range(r.randint(1, 3))) for _ in range(400)]
    bad = ["gnarf" + s for s in ("", "en", "ist", "o")] + ["idiot", "blorgs"]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 120))]
        toxic = r.random() < 0.15
        for _ in range(r.randint(1, 4) if toxic else 0):
            text[r.randrange(len(text))] = r.choice(bad)
        rows.append((i, " ".join(text), "en"))
        if r.random() < 0.8:
            labels.append((i, int(toxic) if r.random() > 0.02 else 1 - int(toxic)))
    truth = {i: any(w in bad for w in t.split()) for i, t, _ in rows}
    return rows, labels, truth


def test_held_out_accuracy_and_folds(spark):
    rows, labels, truth = corpus()
    odd = [(None, None, "x"), (None, "you idiot gnarf", "x"), (0, rows[0][1], "y"), (5000, "", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id BIGINT, text STRING, score STRING")
    marks = spark.createDataFrame(labels, "doc_id BIGINT, toxic INT")
    got = tox.toxicity(docs, marks).collect()
    assert len(got) == len(rows) + 4
    held = [g for g in got if g.held_out]
    assert all(g.held_out == (tox.crc_fold(g.doc_id) == 2) for g in got)
    hit = [bool(g.predicted) == truth.get(g.doc_id, False) for g in held]
    assert np.mean(hit) > 0.95 and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(d, 1 - t if tox.crc_fold(d) == 2 else t) for d, t in labels], "doc_id BIGINT, toxic INT")
    again = tox.toxicity(docs, other).collect()
    assert sorted(round(g.score, 9) for g in again) == sorted(round(g.score, 9) for g in got)
    kept = tox.keep_clean(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(g.predicted == 0 for g in got)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "you are a stupid worthless idiot and a moron"), (2, "plain words in a row")], "doc_id BIGINT, text STRING")
    none = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    got = {g.doc_id: g.predicted for g in tox.toxicity(docs, none).collect()}
    assert got == {1: 1, 2: 0}
    assert tox.toxicity(docs.where("false"), none).collect() == []


def test_label_model_estimates_accuracies():
    r = np.random.default_rng(1)
    y = r.random(6000) < 0.2
    rates = [(0.8, 0.02), (0.5, 0.01), (0.3, 0.05), (0.6, 0.1)]
    votes = np.stack([np.where(y, r.random(6000) < a, r.random(6000) < b) for a, b in rates] + [np.zeros(6000, bool)], 1)
    votes[:, 4] = votes[:, 0]  # a copy of the first voter
    gold = np.where(r.random(6000) < 0.5, y, -1)
    m = tox.LabelModel(votes, gold)
    assert np.allclose(m.hit[:4], [a for a, _ in rates], atol=0.08) and np.allclose(m.false[:4], [b for _, b in rates], atol=0.03)
    assert m.correlation[0, 4] > 0.9 and [set(e) for e in m.edges] == [{0, 4}]
    assert (m.posterior > 0.5)[gold < 0].astype(int).tolist().count(1) > 0
    assert ((m.posterior > 0.5) == y).mean() > 0.93


def test_label_model_against_brute_force():
    """One round of counts and posteriors on 20 rows, by products over the forest."""
    r = np.random.default_rng(4)
    y = r.random(20) < 0.4
    a = np.where(y, r.random(20) < 0.8, r.random(20) < 0.2)
    votes = np.stack([a, a ^ (r.random(20) < 0.1), np.where(y, r.random(20) < 0.7, r.random(20) < 0.3), r.random(20) < 0.5], 1)
    m = tox.LabelModel(votes, np.full(20, -1), rounds=1)
    q = np.clip(0.02 + 0.45 * votes.sum(1), 0.02, 0.95)
    parent = dict(m.edges)
    assert m.edges and all(m.correlation[e] == m.correlation[e[::-1]] and abs(m.correlation[e]) > 0.2 for e in m.edges)
    ratio = np.zeros(20)
    for w, alone, sign, floor, prior in ((q, m.hit, 1, 1e-4, 1.0), (1 - q, m.false, -1, 1e-6, 0.1)):
        for i in range(4):
            want = (sum(w[k] for k in range(20) if votes[k, i]) + prior) / (w.sum() + 2.0)
            assert np.isclose(alone[i], np.clip(want, floor, 1 - 1e-4), rtol=1e-5)
        for k in range(20):
            for i in range(4):
                p = alone[i]
                if i in parent:
                    same = [n for n in range(20) if votes[n, parent[i]] == votes[k, parent[i]]]
                    p = (sum(w[n] for n in same if votes[n, i]) + 4.0 * alone[i]) / (sum(w[n] for n in same) + 4.0)
                ratio[k] += sign * np.log(p if votes[k, i] else 1 - p)
    assert np.allclose(m.evidence(votes.astype(np.float32)), ratio, atol=1e-3)
    assert np.allclose(m.posterior, 1 / (1 + np.exp(-(np.log(q.mean() / (1 - q.mean())) + ratio))), atol=1e-3)


def test_every_significant_term_votes(spark):
    """More terms than any fixed number of slots, each in few rows."""
    r = random.Random(9)
    bad = [f"zq{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(650)]
    rows = [(f"{' '.join(r.choices(bad, k=30))} plain words", 1) for _ in range(400)] + [(" ".join(f"w{r.randint(0, 50)}" for _ in range(9)), 0) for _ in range(1600)]
    found = tox.mined(spark.createDataFrame(rows, "text STRING, toxic INT"), 400, 1600)
    assert sum(w in found for w in bad) > 400 or any(t.startswith("zq") and t.endswith("*") for t in found)
    assert tox.LABELLED >= 24_000


def test_odd_columns_and_long_texts(spark):
    rows, labels, _ = corpus(n=200)
    docs = spark.createDataFrame([(*x, 1.5, "t", 7) for x in rows] + [(9000, "word " * 400_000 + "idiot gnarf", "en", 1.5, "t", 7)], "doc_id BIGINT, text STRING, lang STRING, score DOUBLE, __text STRING, __score INT")
    kept = tox.keep_clean(docs, spark.createDataFrame(labels, "doc_id BIGINT, toxic INT"))
    assert kept.columns == docs.columns
    assert {(k.score, k["__text"], k["__score"]) for k in kept.select("score", "__text", "__score").collect()} == {(1.5, "t", 7)}


def test_five_thousand_voters_stay_within_a_driver():
    """Memory of the label model and the classifier at 24,000 rows; no matrix of pairs of voters is held."""
    import tracemalloc
    from collections import Counter

    r, n, m = np.random.default_rng(1), 24_000, 5_000
    y = r.random(n) < 0.15
    hits = [Counter((a + r.integers(0, 2)) % m for a in r.integers(0, m, r.poisson(30 if t else 0.4)).tolist() for _ in range(2)) for t in y]
    tracemalloc.start()
    votes = tox.Votes([np.array(sorted(c), np.int64) for c in hits], m)
    model = tox.LabelModel(votes, np.where(r.random(n) < 0.97, y, ~y).astype(int), rounds=2)
    linear = tox.Linear(tox.inputs(hits, np.zeros((n, 5)), r.random(m)), model.posterior)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and len(linear.w) == m + 9 and ((model.posterior > 0.5) == y).mean() > 0.97


def test_pairs_by_blocks_and_spanning_forest_against_dense():
    """Pairs of votes, tied pairs that never vote together among them, and the forest of a dense computation."""
    r = np.random.default_rng(6)
    a = r.random(400) < 0.5
    votes = np.stack([a, ~a & (r.random(400) < 0.9), *(np.where(r.random(400) < 0.8, a, r.random(400) < 0.3) for _ in range(4)), *(r.random((5, 400)) < 0.2)], 1)
    w = r.random(400)
    for block in (1, 3, 64):
        whole = np.zeros((2, 11, 11))
        for begin, parts in tox.Votes.of(votes).pairs((w, np.ones(400)), block, at_once=50):
            for k, x in enumerate(parts):
                whole[k, begin : begin + len(x), begin:] = x
        assert np.allclose(np.triu(whole[0]), np.triu((votes * w[:, None]).T @ votes)) and np.allclose(np.triu(whole[1]), np.triu(votes.T.astype(float) @ votes))
    m = tox.LabelModel(votes, np.full(400, -1), rounds=1)
    q = np.clip(0.02 + 0.45 * votes.sum(1), 0.02, 0.95)
    told, tie = np.zeros((11, 11)), np.zeros((11, 11))
    spread = np.zeros(11)
    for u in (q, 1 - q):
        p = (votes * u[:, None]).sum(0) / u.sum()
        spread += u.sum() * p * (1 - p)
        for i in range(11):
            for j in range(11):
                tie[i, j] += (u * votes[:, i] * votes[:, j]).sum() - u.sum() * p[i] * p[j]
                for x in (0, 1):
                    for z in (0, 1):
                        joint = u[(votes[:, i] == x) & (votes[:, j] == z)].sum() / u.sum()
                        told[i, j] += u.sum() * max(joint, 1e-12) * np.log(max(joint, 1e-12) / ((p[i] if x else 1 - p[i]) * (p[j] if z else 1 - p[j])))
    tie /= np.sqrt(np.outer(spread, spread))
    root, want = list(range(11)), set()
    for i, j in sorted(((i, j) for i in range(11) for j in range(i + 1, 11) if abs(tie[i, j]) > 0.2), key=lambda e: -told[e]):
        if root[i] != root[j]:
            root = [root[i] if x == root[j] else x for x in root]
            want.add(frozenset((i, j)))
    assert frozenset((0, 1)) in want and {frozenset(e) for e in m.edges} == want
    assert all(np.isclose(m.correlation[e], tie[e], atol=1e-5) for e in m.edges)


def test_classifier_against_dense_newton():
    from collections import Counter

    r = np.random.default_rng(8)
    hits = [Counter(r.integers(0, 40, r.poisson(3)).tolist()) for _ in range(800)]
    x = tox.inputs(hits, r.random((800, 5)), r.normal(size=40))
    y = np.array([0.95 if c[3] or c[7] else 0.05 for c in hits])
    got = tox.Linear(x, y)
    dense = np.concatenate([np.array([[float(k in c) for k in range(40)] for c in hits]), x.more], 1)
    mean, scale = dense.mean(0), dense.std(0) + 1e-3
    z, w = np.append((dense - mean) / scale, np.ones((800, 1)), 1), np.zeros(50)
    penalty = np.append(np.full(49, 2.0), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
    assert np.allclose(got.score(x), 1 / (1 + np.exp(-z @ w)), atol=1e-5)
