import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sweepgrid.llm import runs


def brute(s, least):
    """Every run by its definition: for each period, maximal stretches where items a period apart agree."""
    out, n = {}, len(s)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, b - a, p) for (a, b), p in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 12))
def test_all_runs_of_small_alphabets(s, least):
    assert runs.maximal_runs(s, least) == brute(s, least)


def test_all_runs_of_structured_words():
    rng = random.Random(3)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    for s in (fib[-1], [0] * 300, [0, 1] * 100 + [0], []):
        assert runs.maximal_runs(s, 12) == brute(s, 12)
    for _ in range(150):
        s = []
        while len(s) < 300:
            part = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randrange(1, 25))]
            s += part * rng.choice([1, 1, 2, 3, 5])
            if rng.random() < 0.3 and s:
                a = rng.randrange(len(s))
                s += s[a : a + rng.randrange(1, 60)]
        assert runs.maximal_runs(s, 12) == brute(s, 12)


def damaged(i, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


def expected(i, text):
    words = damaged(i, text)
    found = brute(words, 12)
    drop = {k for a, n, p in found for k in range(a + p, a + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (
        i, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in drop)).hexdigest(), len(words),
    )


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    line = " ".join(f"w{k}" for k in range(9))
    out = [None, "", " \t\n", "one", "a b c", f"{line}\n{line}", f"{line} x {line} x {line}", "ho " * 5000, "la  la la " * 20]
    for _ in range(300):
        words = [f"v{rng.randrange(rng.choice([3, 400]))}" for _ in range(rng.randrange(1, 120))]
        a = rng.randrange(len(words))
        out.append(" ".join(words[:a] + words[a : a + rng.randrange(1, 40)] * rng.choice([1, 2, 4]) + words[a:]))
    return out + [" ".join(f"r{rng.randrange(10**6)}" for _ in range(40_000)) + " end of it" * 4000]


def test_query_against_brute_force(spark, tmp_path, texts):
    rows = [(k, t, "x") for k, t in enumerate(texts[:-1])] + [(3, "a b " * 10, None), (3, "a b " * 10, None), (None, "a b " * 10, None)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, runs STRING").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((expected(i, t) for i, t, _ in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 50


def test_query_on_given_documents(spark):
    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in runs.op13_periodic_runs(spark, d).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    short = [(i, t) for i, t in docs if len(t.split()) < 1500]
    assert len(got) == len(docs) and len(short) > 150
    assert [got[i] for i, _ in short] == [expected(i, t) for i, t in short]


def test_very_long_text_and_further_columns(spark, texts):
    df = spark.createDataFrame([(1, texts[-1], "keep", "mine")], "doc_id INT, text STRING, runs_ STRING, Text_ STRING")
    row = runs.with_runs(df).first()
    assert [tuple(r) for r in row["runs"]] == [(40_000, 12_000, 3)] and row["n_words"] == 52_000
    assert row["runs_"] == "keep" and row["Text_"] == "mine" and row["collapsed"].endswith(" end of it")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    assert runs.op13_periodic_runs(spark, str(tmp_path)).count() == 0
