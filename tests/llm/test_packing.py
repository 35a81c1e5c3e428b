import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from sweepgrid.llm import packing
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def texts(seed=1, n=300):
    r = random.Random(seed)
    bits = ["The", "word", "don't", "it's.", "a.b", "x1y2", "…", "É", "straße!", "İstanbul,", "ΣΑΣ.", "漢字。", "12,345.67", "<|endoftext|>", "<|ENDOFTEXT|>.", "a<|endoftext|>b", " ", "é.", "́", "!!!", "'S", "U.S.A.", "​", "🙂", "foo?!", "½.", "x y"]
    return ["", None, " ", "\n\n", "a" * 5000, "ab " * 3000] + [r.choice([" ", "\n", "  ", "\t"]).join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_ids_are_those_of_whole_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 12)
    for _ in range(2):
        ids, sizes = packing.WordTokenizer(packing.default_tokenizer()).encode(pa.array(texts()))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts()]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
        monkeypatch.undo()


def test_pieces_are_a_partition(spark, tokenizer, monkeypatch):
    rows = list(zip([None, 5, 5, *range(10, 500)], texts(2)))
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id BIGINT, text STRING, part INT").repartition(5)
    got = packing.packed(docs, length=64).collect()
    want = sorted((d is not None, d or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows)
    by_place = sorted(got, key=lambda p: (p.sequence_id, p.offset))
    at, stream, docs_seen, current = 0, [], [], []
    for p in by_place:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert p.sequence_id * 64 + p.offset == at and len(ids) == p.length and p.offset + p.length <= 64
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == p.ids_crc32 and p.start == len(current)
        at, current = at + p.length, current + ids
        if len(current) == p.doc_tokens:
            docs_seen.append((p.doc_id is not None, p.doc_id or 0, current))
            current = []
        stream += ids
    assert sorted(docs_seen) == want
    # offsets joined by key, as beyond the broadcast's bound, place the pieces alike
    monkeypatch.setattr(packing, "BROADCAST_PARTS", 0)
    key = lambda rows: sorted((p.sequence_id, p.offset, p.length, p.ids_crc32) for p in rows)
    assert key(packing.packed(docs, length=64).collect()) == key(got)
    whole = packing.sequences(packing.packed(docs, length=64), 64).collect()
    assert sum(s.n for s in whole) == len(stream)
    assert all(len(s.ids) == 64 or s.n & (s.n - 1) == 0 for s in whole)
    assert packing.packed(spark.createDataFrame([], "doc_id BIGINT, text STRING")).collect() == []


def same(tokenizer, encoder, words):
    for k in range(0, len(words), 50_000):
        part = words[k : k + 50_000]
        ids, sizes = encoder.encode(pa.array(part))
        want = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_every_character_before_and_after_punctuation_and_marks(tokenizer):
    encoder = packing.WordTokenizer(packing.default_tokenizer())
    chars = [c for c in map(chr, range(1, 0x11000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    for form in ("{}", "a{}?!", "{}\u0301.", "H\u0331{};"):
        same(tokenizer, encoder, [form.format(c) for c in chars])


def test_mixed_scripts(tokenizer):
    r = random.Random(5)
    pool = [c for c in map(chr, range(1, 0x3000)) if unicodedata.category(c) != "Cn"] + list("abcABCHTWYJI.,;:!?'<|09 ") * 60 + list("\u0301\u0308\u030a\u030c\u0331\u0307") * 80
    same(tokenizer, packing.WordTokenizer(packing.default_tokenizer()), ["".join(r.choices(pool, k=r.randint(1, 14))) for _ in range(60_000)])


def test_a_word_is_learned_once_whatever_punctuation_follows(tokenizer):
    encoder = packing.WordTokenizer(packing.default_tokenizer())
    same(tokenizer, encoder, ["onedor$$$ onedor%%% Onedor, onedor", "onedor.", "x<|endoftext|>$$$", "don't'", "a'.", "7$", "été@"])
    assert {"onedor", "$$$", "%%%", ",", ".", "don't", "'", "a", "'.", "7", "$", "été", "@", "x<|endoftext|>$$$"} == set(encoder.known)
