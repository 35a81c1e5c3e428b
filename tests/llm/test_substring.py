import hashlib
import random

import pytest
from sweepgrid.llm import substring
from sweepgrid.llm.substring import substring_dedup


def brute(rows, window=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def fixture(seed, docs=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "the", "a.", "漢字"]
    passages = [[r.choice(vocabulary) for _ in range(r.choice([12, 13, 14, 40, 70]))] for _ in range(8)]
    rows = [(None, "x " * 30), (None, None), (3, ""), (5, None), (7, "one"), (7, " ".join(passages[0])), (8, "a " * 200), (9, "a " * 100), (9, "a " * 100), (10, "\t\n ")]
    for i in range(docs):
        text = []
        for _ in range(r.randint(0, 5)):
            text += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(1, 30))]
        rows.append((20 + r.randint(0, docs), r.choice([" ", "\n", "  "]).join(text)))
    return rows


@pytest.mark.parametrize("seed,hot,shard", [(1, 1000, 20_000), (2, 3, 5), (3, 10, 50)])
def test_against_brute_force(spark, seed, hot, shard):
    rows = fixture(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id BIGINT, text STRING, th STRING")
    got = [tuple(r) for r in substring_dedup(docs, hot_docs=hot, shard_segments=shard).drop("kept_text").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_letters_of_a_shard():
    """All distinct, none a surrogate, and two characters only past the first million words."""
    some = [*range(0, 3000), *range(0xD7F0, 0xD820), *range(substring.SINGLE - 5, substring.SINGLE + 70_000), 3_000_000, (1 << 30) - 1 + substring.SINGLE]
    got = [substring.letter(n) for n in some]
    assert len(set(got)) == len(set(some)) and all(len(c) == 1 + (n >= substring.SINGLE) for n, c in zip(some, got))
    assert not any(0xD800 <= ord(x) < 0xE000 or x == "\0" for c in got for x in c)
    assert not {x for n, c in zip(some, got) if n >= substring.SINGLE for x in c} & {c for n, c in zip(some, got) if n < substring.SINGLE}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force_past_the_single_letters(spark, seed, monkeypatch):
    """Words of one and of two characters in the same windows."""
    rows = fixture(seed)
    shard = substring.Shard(13)
    monkeypatch.setattr(substring, "SINGLE", 60)
    texts = [(d, (t or "").encode().split()) for d, t in rows if d is not None]
    where = {}
    for d, w in texts:
        if len(w) >= 13:
            shard.add(b" ".join(w), d, 0, 0)
            where.setdefault(b" ".join(w), set()).add(d)
    shard.compile()
    gone = {}
    for seg, ids in shard.texts.items():
        for doc, _, a, b in shard.locate(seg, ids):
            gone.setdefault((doc, seg), set()).update(range(a, b))
    assert len(shard.alphabet) > 200
    for d, n, removed, _ in brute([(d, t) for d, t in rows if d is not None]):
        assert n < 13 or removed in {len(gone.get((d, seg), ())) for seg, ids in where.items() if d in ids}


def test_more_distinct_words_than_characters():
    """A shard of 1.3 million distinct words; a passage of the last of them recurs."""
    shard = substring.Shard(13)
    words = [b"w%d" % i for i in range(1_300_000)]
    for k in range(0, len(words), 64):
        shard.add(b" ".join(words[k : k + 64]), k, 7, 0)
    last = b" ".join([b"own", *words[-20:-3], b"end"])
    shard.add(last, 5_000_000, 7, 100)
    shard.compile()
    assert list(shard.locate(last, shard.texts[last])) == [(5_000_000, 7, 101, 118)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert substring_dedup(docs).collect() == []


def test_long_texts_and_extra_columns(spark):
    r = random.Random(6)
    long = [f"w{r.randint(0, 3000)}" for _ in range(120_000)]
    rows = [(4, " ".join(long)), (9, " ".join(["new"] * 20 + long[500:90_000])), (None, " ".join(long)), (2, "a b"), (2, None)]
    docs = spark.createDataFrame([(*x, 1, "q", [2]) for x in rows], "doc_id BIGINT, text STRING, key INT, h STRING, plain ARRAY<INT>")
    got = [tuple(x) for x in substring_dedup(docs).drop("kept_text").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
