import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sweepgrid.llm import lm


def split(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w.translate(table) for w in (text or "").encode().decode().replace("\t", " ").replace("\n", " ").split(" ") if w] + [None]


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10


def rows(seed=3):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(1.1))}" for _ in range(4000)] + ["The", "THE", "É", "é"]
    follows = {w: r.choice(words) for w in words}
    out = []
    for i in range(300):
        text = [r.choice(words)]
        for _ in range(r.randint(0, 60)):
            text.append(follows[text[-1]] if r.random() < 0.7 else r.choice(words))
        out.append((i, " ".join(text)))
    return out + [(None, "w1 w2"), (None, None), (5, ""), (6, None), (7, "a\tb\nC"), (8, "w1 " * 3000)]


@pytest.mark.parametrize("group", [1 << 30, 2000])
def test_counts_and_base_against_brute_force(spark, group):
    data = rows()
    got = lm.lm_scores(spark.createDataFrame(data, "doc_id BIGINT, text STRING").repartition(5), group_bytes=group, shard_bytes=3000).collect()
    train = Counter(w for d, t in data if fold(d) for w in split(t))
    n, v = sum(train.values()), len(train)
    want = []
    for d, t in data:
        words = split(t)
        want.append((d, fold(d) == 0, len(words), sum(train[w] > 0 for w in words), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    key = lambda x: (str(x[0]), x[2], x[3], round(x[5], 6))
    for a, b in zip(sorted((tuple(g) for g in got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
        assert a[6] <= 0
    held = [g for g in got if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_bigram_counts(spark):
    data = rows(4)
    pairs, contexts, singles = Counter(), Counter(), Counter()
    for d, t in data:
        if fold(d):
            w = ["<s>", *split(t)]
            contexts.update(w[:-1])
            singles.update(w[1:])
            pairs.update(zip(w, w[1:]))
    n, v = sum(singles.values()), len(singles)
    captured = {}
    real = lm._score
    try:
        lm._score = lambda *a: captured.setdefault("w", a) and real(*a)
        got = lm.lm_scores(spark.createDataFrame(data, "doc_id BIGINT, text STRING"), group_bytes=3000, shard_bytes=3000).collect()
    finally:
        lm._score = real
    weights = np.array(captured["w"][2])
    assert weights.sum(1) == pytest.approx(1) and captured["w"][:2] == (n, v)
    want = []
    for d, t in data:
        total, w = 0.0, ["<s>", *split(t)]
        for a, b in zip(w, w[1:]):
            k = int(np.searchsorted(lm.BUCKETS, contexts[a]))
            total += math.log10(weights[k, 0] * pairs[a, b] / max(contexts[a], 1) + weights[k, 1] * singles[b] / n + weights[k, 2] / (v + 1))
        want.append(total)
    assert sorted(g.score for g in got) == pytest.approx(sorted(want))


def test_empty_and_untrained(spark):
    assert lm.lm_scores(spark.createDataFrame([], "doc_id BIGINT, text STRING")).collect() == []
    only = lm.lm_scores(spark.createDataFrame([(None, "a b")], "doc_id BIGINT, text STRING")).collect()
    assert only[0].train_tokens == 0 and only[0].n_known == 0 and only[0].n_tokens == 3


def test_blobs():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 999, dtype=np.uint64))
    assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()
    for counts in (np.array([0, 1, 254, 255, 256, 10**12]), np.arange(500), np.zeros(0, np.int64)):
        assert (lm.unpack_counts(lm.pack_counts(counts), len(counts)) == counts).all()


def test_work_of_a_group_does_not_grow_with_the_shards():
    """Rows follow the keys of the group, also where shards are many more than those of 30 GB."""
    texts = [t for _, t in rows() if t] * 3
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    unique = len(np.unique(lm.Tokens(pa.array(texts), 3).grams[2]))
    few, many = (lm._ask(shards, (2,))((pa.scalar(7),), table) for shards in (64, 1 << 24))
    assert sum(few["n"].to_pylist()) == sum(many["n"].to_pylist()) == unique
    assert few.num_rows <= 64 and many.num_rows <= unique
    keys = lambda t: np.concatenate([lm.unpack_keys(k) for k in t["keys"].to_pylist()])
    assert (keys(few) == keys(many)).all()
    began = time.process_time()
    lm._ask(1 << 30, (2,))((pa.scalar(7),), table)
    assert time.process_time() - began < 20


@pytest.mark.parametrize("order", [3, 4])
def test_longer_orders_against_brute_force(spark, order):
    data = rows(4)
    grams, contexts, singles = Counter(), Counter(), Counter()
    padded = lambda t: ["<s>"] * (order - 1) + split(t)
    each = lambda t, m: ((tuple(w[i - m + 1 : i]), w[i]) for w in [padded(t)] for i in range(order - 1, len(w)))
    for d, t in data:
        if fold(d):
            singles.update(split(t))
            for m in range(2, order + 1):
                grams.update(each(t, m))
                contexts.update(c for c, _ in each(t, m))
    n, v = sum(singles.values()), len(singles)
    captured = {}
    real = lm._score
    try:
        lm._score = lambda *a: captured.setdefault("w", a) and real(*a)
        docs = spark.createDataFrame(data, "doc_id BIGINT, text STRING")
        got = lm.lm_scores(docs, group_bytes=3000, shard_bytes=3000, order=order).collect()
    finally:
        lm._score = real
    weights, longer = np.array(captured["w"][2]), captured["w"][3]
    assert len(longer) == order - 2 and all(x[0] == 0 and 0 < max(x) <= 1 for x in longer)
    want = []
    for d, t in data:
        p = []
        for c, w in each(t, 2):
            k = int(np.searchsorted(lm.BUCKETS, contexts[c]))
            p.append(weights[k, 0] * grams[c, w] / max(contexts[c], 1) + weights[k, 1] * singles[w] / n + weights[k, 2] / (v + 1))
        for m, share in zip(range(3, order + 1), longer):
            for i, (c, w) in enumerate(each(t, m)):
                s = share[int(np.searchsorted(lm.BUCKETS, contexts[c]))]
                p[i] = s * grams[c, w] / max(contexts[c], 1) + (1 - s) * p[i]
        want.append(sum(map(math.log10, p)))
    assert sorted(g.score for g in got) == pytest.approx(sorted(want))


def test_trigrams_tell_what_bigrams_cannot(spark):
    """The word after "x" depends on the word before it."""
    r = random.Random(7)
    data = [(i, " ".join(f"{a} x {a}{a}" for a in r.choices("abcdefgh", k=20))) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id BIGINT, text STRING")
    held = [sum(g.score for g in lm.lm_scores(docs, order=o).collect() if g.held_out) for o in (2, lm.ORDER)]
    assert held[1] > held[0] * 0.8
