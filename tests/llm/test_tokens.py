import random

import pytest

from sweepgrid.llm import tokens


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.tokenizer_of(tokens.default_tokenizer())


def whole(t, text):
    return len(t.encode(text or "", add_special_tokens=False).ids)


def awkward(rng, n):
    parts = ["it's", "we'll", "'ll", "'", "  ", "\n\n\t ", " ", "<|endoftext|>", "<|endof", "|>", "été", "漢字かな", "😀🏳️‍🌈", " ", "　", "12345", "a" * 40, "ab", "…", "!?!", "x\r\n", "\x00", "ﬀ", "é"]
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.choice(parts) * rng.choice([1, 1, 1, 2, 7]))
    return "".join(out)


def cut(text, n):
    return iter([text[k : k + n] for k in range(0, len(text), n)])


def test_spliced_is_whole(tokenizer):
    rng = random.Random(5)
    texts = [awkward(rng, rng.randrange(1, 1500)) for _ in range(150)]
    texts += ["a" * 3000, "ab " * 1000, " " * 2000 + "x", "\n" * 999, "", "é" * 2500, "<|endoftext|>" * 200, "x" * 700 + " y" * 500 + "1" * 900]
    for text in texts:
        for n, overlap in ((60, 40), (97, 48), (200, 64)):
            assert tokens.spliced(tokenizer, cut(text, n), overlap) == whole(tokenizer, text), (text[:80], n)


def test_pieces_add_up_to_the_whole(tokenizer, monkeypatch):
    rng = random.Random(11)
    texts = [awkward(rng, rng.randrange(1, 400)) for _ in range(300)] + ["", " ", "\n", "  ", " \n", "\n ", "a\n\nb", "a \n b", "x  \n\n  y", "'s 's's", "it 's", "12 34a", " .. a", "a\u00a0\n\nb", "a\x1c b", "\u180e x"]
    plain = [" ", "  ", "\n", "\n\n", "   \n", "é", "ab", "'s", "'ll", "'", "12", "1a", ".", "!?", "<", "|", "日本", "😀"]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    want = [whole(tokenizer, t) for t in texts]
    assert tokens.counts(tokenizer, texts, {}) == want
    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    known = {}
    assert [n for k in range(0, len(texts), 9) for n in tokens.counts(tokenizer, texts[k : k + 9], known)] == want


def test_chunks_across_tasks(spark, tokenizer):
    rng = random.Random(6)
    texts = [None, "", "hello", "word " * 5000, "q" * 4000, "<|endoftext|>" * 300] + [awkward(rng, rng.randrange(1, 6000)) for _ in range(80)]
    rows = [(k % 7 or None, t, "x", k) for k, t in enumerate(texts)] + [(3, "tie " * 900, "y", 1000), (3, "tie " * 900, "y", 1000)]
    df = spark.createDataFrame(rows, "doc_id INT, text STRING, key STRING, `key_` INT").repartition(5)
    got = tokens.with_counts(df, chunk=300, overlap=100).collect()
    want = sorted((k, len((t or "").encode()), whole(tokenizer, t)) for _, t, _, k in rows)
    assert sorted((r["key_"], r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_pairs_that_do_not_align_are_widened(spark, tokenizer):
    df = spark.createDataFrame([(1, "z" * 5000 + " and more" * 400), (2, "plain words " * 400)], "doc_id INT, text STRING")
    rows = [(k, i, i == -(-len(t) // 300) - 1, t[300 * i : 300 * i + 400]) for k, t in df.collect() for i in range(-(-len(t) // 300))]
    chunks = spark.createDataFrame(rows, "key BIGINT, number INT, final BOOLEAN, text STRING")
    path = tokens.default_tokenizer()
    first = {r["key"]: r["n"] for r in tokens._joined(chunks, path, 300, 100).collect()}
    assert first == {1: None, 2: whole(tokenizer, "plain words " * 400)}
    again = {r["key"]: r["n"] for r in tokens._widened(chunks, path, 300, 100).collect()}
    assert again[1] == whole(tokenizer, "z" * 5000 + " and more" * 400) and again[2] == first[2]


def test_very_long_texts(spark, tokenizer):
    rng = random.Random(8)
    long = " ".join(rng.choice(["über", "wörter,", "it's", "12", "\n"]) for _ in range(120_000))
    df = spark.createDataFrame([(1, long), (2, "m" * 200_000), (3, long[:65536]), (4, long[:65537])], "doc_id INT, text STRING")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.with_counts(df).collect()}
    assert got == {r["doc_id"]: whole(tokenizer, r["text"]) for r in df.collect()}


def test_query_on_given_documents(spark, tokenizer):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = tokens.op12_token_counts(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        n = whole(tokenizer, docs[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((docs[r["doc_id"]] or "").encode()), n, n > 512)


def test_empty_table(spark):
    assert tokens.with_counts(spark.createDataFrame([], "doc_id INT, text STRING")).count() == 0
