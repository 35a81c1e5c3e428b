import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from sweepgrid.llm import near
from sweepgrid.llm.components import components


def sets(rows, n=5):
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, threshold=0.8):
    s = sets(rows)
    reps = {}
    for (d, _), x in zip(rows, s):
        if x and d is not None:
            reps[x] = min(reps.get(x, d), d)
    label = {d: d for d in reps.values()}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    links = dict.fromkeys(reps, 0)
    for a, b in combinations(reps, 2):
        shared = len(a & b)
        if shared >= threshold * (len(a) + len(b) - shared) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(reps[a]), find(reps[b])
            label[max(x, y)] = min(x, y)
    return sorted((d, find(reps[x]) if x and d is not None else d, links.get(x, 0) if d is not None else 0) for (d, _), x in zip(rows, s))


def fixture(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 400)}"
    rows, base = [], [[word() for _ in range(r.choice([3, 5, 6, 9, 40, 200]))] for _ in range(25)]
    for i in range(260):
        text = list(r.choice(base)) if r.random() < 0.8 else [word() for _ in range(r.randint(1, 60))]
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            text[r.randrange(len(text))] = word()
        rows.append((i * 3, r.choice([" ", "\n"]).join(text)))
    r.shuffle(rows)
    return rows + [(5000, None), (5001, ""), (5002, "  "), (5003, "a"), (5004, "a"), (5005, "a b")]


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 7)])
def test_against_brute_force(spark, seed, block):
    rows = fixture(seed)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id BIGINT, text STRING, cell INT, n INT")
    got = near.near_join(docs, block=block).collect()
    assert sorted((g.doc_id, g.class_id, g.n_links) for g in got) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (None, None)]
    got = near.near_join(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert len(got) == 6 and {g.class_id for g in got if g.doc_id == 1} == {1} and {g.class_id for g in got if g.doc_id is None} == {None}
    kept = near.keep_one(spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id BIGINT, text STRING, label STRING, row INT"))
    assert kept.columns == ["doc_id", "text", "label", "row"]
    one = (1, "a b c d e f", 5)  # twice, the same document
    assert sorted((r.doc_id or 0, r.text or "", r.row) for r in kept.collect()) == [(0, "", 5), (0, "a b c d e f", 5), one, one, (2, "u v w x y z", 5)]
    near_ = " ".join(f"w{i}" for i in range(60))
    pair = near.keep_one(spark.createDataFrame([(1, near_), (1, near_ + " end"), (1, "other words here for one more text"), (7, ""), (8, None)], "doc_id BIGINT, text STRING")).collect()
    assert sorted((r.doc_id, (r.text or "").startswith("other")) for r in pair) == [(1, False), (1, True), (7, False), (8, False)]
    assert near.near_join(spark.createDataFrame([], "doc_id BIGINT, text STRING")).collect() == []
    assert near.keep_one(spark.createDataFrame([], "doc_id BIGINT, text STRING")).collect() == []


@pytest.mark.parametrize("x,y", [("a b c d e f", "u v w x y z"), ("u v w x y z", "a b c d e f")])
def test_an_id_that_stands_for_two_sets_loses_neither(spark, x, y):
    got = near.near_join(spark.createDataFrame([(1, x), (1, y), (2, y), (3, y)], "doc_id BIGINT, text STRING")).collect()
    assert sorted((g.doc_id, g.class_id, g.n_copies) for g in got) == [(1, 1, 1), (1, 1, 3), (2, 1, 3), (3, 1, 3)]


def test_crowded_cells_of_many_sizes(spark):
    """Chains of texts that each link to the next, over several size classes and blocks."""
    words, rows = [f"w{i}" for i in range(400)], []
    for i, n in enumerate(range(30, 400, 3)):
        rows.append((i, " ".join(words[:n])))
        rows.append((1000 + i, " ".join([*words[:n], f"x{i}"])))
    got = near.near_join(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), block=9).collect()
    assert sorted((g.doc_id, g.class_id, g.n_links) for g in got) == brute(rows)
    assert len({g.class_id for g in got}) == 1


def test_recall_on_documents(spark):
    """All links and classes of the driver's documents, against brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted((g.doc_id, g.class_id, g.n_links) for g in near.near_join(docs).collect())
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    links = sum(w[2] for w in want)
    assert links > 0 and sum(g[2] for g in got) / links >= 0.99
    assert sum(a == b for a, b in zip(got, want)) / len(want) >= 0.99


def test_very_long_text(spark):
    r = random.Random(2)
    long = [f"w{r.randint(0, 5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:30_000] + ["changed"] + long[30_001:])), (3, " ".join(long[:20_000]))]
    got = near.near_join(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert sorted((g.doc_id, g.class_id, g.n_links) for g in got) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_depth_reaches_the_recall():
    k = near.depth(near.TREES, near.LONGEST, 0.8, near.RECALL)
    assert 1 - (1 - 0.8**k) ** near.TREES >= near.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** near.TREES


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (300, 100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(60)]
    label = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {x.id: x.label for x in components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {v: x for v, x in label.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_edges_of_one_task_need_no_round(spark, monkeypatch):
    """A long chain and a crowd were three rounds of eight stages; a task that holds them makes stars of them."""
    from sweepgrid.llm import components as c

    written, materialise = [], c.materialise
    monkeypatch.setattr(c, "materialise", lambda df, what: written.append(df._jdf.queryExecution().executedPlan().toString()) or materialise(df, what))
    edges = [(i + 1, i) for i in range(500)] + [(1000 + i, 1000 + j) for i in range(30) for j in range(i)]
    got = {x.id: x.label for x in components(spark.createDataFrame(edges, "a BIGINT, b BIGINT").coalesce(1)).collect()}
    assert got == {i: 0 for i in range(501)} | {1000 + i: 1000 for i in range(30)}
    assert len(written) == 2 and not any("Join" in p for p in written)
    # tasks that hold parts of one component still take rounds
    r = random.Random(6)
    edges = [(i, r.randrange(i)) for i in range(1, 400)]
    monkeypatch.setattr(c, "AT_ONCE", 7)
    assert {x.id: x.label for x in components(spark.createDataFrame(edges, "a BIGINT, b BIGINT").repartition(9)).collect()} == dict.fromkeys(range(400), 0)


def edges_of(labels, sizes, least=7, shortest=near.SHORTEST, room=near.ROOM):
    """Pairs of items (by place) that meet in some tree."""
    met = set()
    root = near.roots(labels, shortest)
    for t in range(labels.shape[1]):
        rest = labels[:, t, shortest:]
        order = np.lexsort((*rest.T[::-1], root[:, t]))
        a, b = near.meet(root[order, t], rest[order], order, sizes[order], least, shortest, room, 0.8)
        met |= {frozenset(e) for e in zip(a.tolist(), b.tolist())}
    return met


def components_of(edges):
    label = {}
    find = lambda v: v if label.setdefault(v, v) == v else find(label[v])
    for a, b in map(tuple, edges):
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(label)}


def test_measured_recall_at_the_threshold():
    """Isolated pairs at a similarity of exactly 0.8, whose prefixes have room to be shortened."""
    r, pairs = np.random.default_rng(8), 3000
    a, b = near.permutations(near.TREES, near.LONGEST)
    sets = []
    for _ in range(pairs):
        x = r.integers(0, 1 << 64, 100, dtype=np.uint64)
        sets += [x[:90], x[10:]]
    labels = np.stack([near.signature(x, a, b) for x in sets]).reshape(-1, near.TREES, near.LONGEST)
    met = edges_of(labels, np.full(len(sets), 90))
    assert sum(frozenset((2 * i, 2 * i + 1)) in met for i in range(pairs)) / pairs >= 0.999


def test_climb_against_brute_force():
    """Labels of few values, so that nodes of all depths are crowded."""
    r = np.random.default_rng(3)
    labels = r.integers(0, 2, (300, 2, 10)).astype(np.uint32)
    sizes = r.choice([50, 60, 90], 300)
    met = edges_of(labels, sizes, least=7, shortest=5, room=12)
    linked = components_of(met)
    for t in range(2):
        count = {d: Counter(tuple(x[t, :d]) for x in labels) for d in (5, 6)}
        assert {c for c in count[6].values() if c <= 12} and {c for c in count[5].values() if c > 12}
        for i, j in combinations(range(300), 2):
            same = next((d for d in range(10) if labels[i, t, d] != labels[j, t, d]), 10)
            short = any(same >= d and count[d][tuple(labels[i, t, :d])] <= 12 for d in (5, 6))
            if short and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]):
                assert frozenset((i, j)) in met
            elif same >= 7 and not short:
                assert linked[i] == linked[j]
