"""Token counts of whole texts; huge ones are encoded in overlapping chunks and spliced where both sides agree.

A byte-level BPE tokenizer first cuts a text into pre-tokens, from left to right and without looking back,
and merges inside a pre-token only. So once two encodings share the border of a pre-token, they agree from
there on, and a border of an encoding that began at a true border is itself true unless the end of the chunk
was in sight: deciding on it takes the characters up to the end of a special string or of a contraction,
which are fewer than ``MARGIN``. By induction from the first chunk, the first common border in an overlap,
``MARGIN`` before its end, is a border of the whole text, and the tokens of the text are those of each chunk
between its two splices. Token borders inside a pre-token prove nothing and are not used.

Texts up to ``CHUNK`` characters are counted in one pass without a shuffle, most of them piece by piece (``counts``). Longer ones become rows of
chunks, which are dealt over all tasks by text and number, so a huge text is no single task; each chunk tells
only the borders in its overlaps, and pairs of neighbours meet by (text, number). Where a pair has no common
border, as in a run of letters longer than the overlap, the chunks of that text are gone through again in
order with overlaps four times as wide each time, up to whole chunks, and chunks that still do not align are
encoded as one; what is held is then as long as the longest stretch without a border, which is what the
tokenizer itself must see at once.

Defined cases: a null text is empty and has no tokens; special strings inside a text are special tokens, as
is the tokenizer's default; rows with null, repeated or tied ids are texts of their own; an empty table gives
an empty table; further columns of any name pass through ``with_counts``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.llm.shared import materialise, table, unused
from sweepgrid.llm.words import slices

#: Characters of a chunk and of an overlap.
CHUNK, OVERLAP = 1 << 16, 512
#: Characters before the end of a chunk that its borders may depend on.
MARGIN = 32


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def tokenizer_of(path: str):
    """One tokenizer for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


#: Pieces whose counts a task keeps.
KEPT_PIECES = 1 << 20
#: A word with the space before it, white space up to the last of a run, the last one. The tokenizer itself parts there:
#: words and white space never share a pre-token but for one space before a word, and it looks one character ahead only.
_PIECES = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]").findall
#: Other white space, or what may be a special string: such texts go to the tokenizer whole.
_OTHER = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]|<\|").search


def counts(tokenizer, texts: list[str], known: dict[str, int]) -> list[int]:
    """Tokens of whole texts. Those of plain spaces and line ends are the sum of their pieces' tokens, and each piece is
    encoded once while it is in ``known``."""
    parts = [None if _OTHER(x) else _PIECES(x) for x in texts]
    new = list({p for ps in parts if ps for p in ps}.difference(known))
    if len(known) + len(new) > KEPT_PIECES:
        known.clear()
        new = list({p for ps in parts if ps for p in ps})
    for k in range(0, len(new), 4096):
        part = new[k : k + 4096]
        known.update(zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False))))
    whole = iter(tokenizer.encode_batch_fast([x for x, ps in zip(texts, parts) if ps is None], add_special_tokens=False))
    return [len(next(whole)) if ps is None else sum(map(known.__getitem__, ps)) for ps in parts]


def borders(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(characters where pre-tokens begin, tokens before each, tokens of all)."""
    e = tokenizer.encode(text, add_special_tokens=False)
    if not len(e):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    word = np.array(e.word_ids, np.int64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    return np.fromiter((o[0] for o in e.offsets), np.int64, len(e))[first], first, len(e)


def ends(tokenizer, text: str, last: bool, chunk: int, overlap: int, begins: bool) -> tuple[dict[int, int], dict[int, int], int]:
    """Of one chunk with its overlap: borders in the overlap before, counted from the chunk's beginning; those in the
    overlap behind, counted from the next one's; all tokens. Each with the tokens before it."""
    at, before, n = borders(tokenizer, text)
    head = {} if begins else dict(zip(at[(k := at < overlap)].tolist(), before[k].tolist()))
    tail = {} if last else dict(zip((at[(k := (at >= chunk) & (at + MARGIN <= chunk + overlap))] - chunk).tolist(), before[k].tolist()))
    return head, tail, n


def spliced(tokenizer, chunks: Iterator[str], overlap: int = OVERLAP) -> int:
    """Tokens of the text that the chunks (without overlaps) make up, one after the other: neighbours are aligned in
    overlaps that widen until they agree, and joined where they never do."""
    total = since = 0
    current, wait, ahead, done = next(chunks, ""), 1, [], False
    while not done:
        while len(ahead) < wait and (more := next(chunks, None)) is not None:
            ahead.append(more)
        if not ahead:
            break
        done = len(ahead) < wait
        text, width = "".join(ahead), overlap
        there, after, _ = borders(tokenizer, text)
        while True:
            whole = width >= len(text)
            here, before, _ = borders(tokenizer, current + text[:width])
            # the end of what has come so far is no proof of anything, unless it is far enough
            good = here[(here >= len(current)) & (here + MARGIN <= len(current) + min(width, len(text)))] - len(current)
            both = good[np.isin(good, there)]
            if len(both) or whole:
                break
            width *= 4
        if len(both):
            p = int(both[0])
            total += int(before[np.searchsorted(here, p + len(current))]) - since
            since = int(after[np.searchsorted(there, p)])
            current, wait = text, 1
        else:
            # twice as much the next time, so that a text without borders costs n log n
            current, wait = current + text, 2 * wait
        ahead = []
    return total + len(tokenizer.encode(current, add_special_tokens=False)) - since


def with_counts(docs: DataFrame, tokenizer: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` without their texts, with the bytes (UTF-8) and the tokens of each."""
    path = tokenizer or default_tokenizer()
    carry = [c for c in docs.columns if c != "text"]
    text, size, tokens, key, number, final, head, tail = unused(docs.columns, "text_", "bytes_", "tokens_", "key_", "number_", "final_", "head_", "tail_")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kept = "".join(f"`{c}` {fields[c]}, " for c in carry)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with its tokens; of a huge one, a row for each chunk instead."""
        t, row, known = tokenizer_of(path), TaskContext.get().partitionId() << 33, {}
        for batch in slices(batches, text):
            texts = batch.column(text).to_pylist()
            short = [k for k, x in enumerate(texts) if len(x) <= chunk]
            of = dict(zip(short, counts(t, [texts[k] for k in short], known)))
            taken, out = [], {size: [], tokens: [], key: [], number: [], final: [], text: []}
            for k, x in enumerate(texts):
                parts = range(0, len(x), chunk) if k not in of else (None,)
                for i, begin in enumerate(parts):
                    taken.append(k)
                    out[size].append(len(x.encode()))
                    out[tokens].append(of.get(k))
                    out[key].append(row)
                    out[number].append(i)
                    out[final].append(begin is None or begin + chunk >= len(x))
                    out[text].append(None if begin is None else x[begin : begin + chunk + overlap])
                row += 1
            kinds = {size: pa.int64(), tokens: pa.int64(), key: pa.int64(), number: pa.int32(), final: pa.bool_(), text: pa.string()}
            rows = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in carry), *(pa.array(out[c], kinds[c]) for c in out)], names=[*carry, *out])

    # written once: every chunk of a text then has the same key, whatever task is run again
    narrow = docs.select(*[F.col(f"`{c}`") for c in carry], F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    counted = materialise(narrow.mapInArrow(first, f"{kept}`{size}` BIGINT, `{tokens}` BIGINT, `{key}` BIGINT, `{number}` INT, `{final}` BOOLEAN, `{text}` STRING"), "token-counts")
    chunks = counted.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(number).alias("number"), F.col(final).alias("final"), F.col(text).alias("text"))
    found = materialise(_joined(chunks, path, chunk, overlap), "token-splices")
    again = _widened(chunks.join(found.where("n IS NULL").select("key"), "key", "left_semi"), path, chunk, overlap)
    huge = counted.where(F.col(text).isNotNull() & (F.col(number) == 0)).drop(tokens)
    n = found.where("n IS NOT NULL").unionByName(again).select(F.col("key").alias(key), F.col("n").alias(tokens))
    both = counted.where(F.col(text).isNull()).select(*[F.col(f"`{c}`") for c in carry], size, tokens)
    both = both.unionByName(huge.join(n, key).select(*[F.col(f"`{c}`") for c in carry], size, tokens))
    return both.withColumnsRenamed({size: n_bytes, tokens: n_tokens})


def _joined(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n) of each text from its chunks' overlaps; n is null where two neighbours share no border."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_of(path)
        for batch in slices(batches, most=1 << 16):
            # a row for the border behind the chunk, and one for that before it
            out = {"key": [], "border": [], "behind": [], "ahead": [], "rest": []}
            for row in batch.to_pylist():
                k = row["number"]
                head, tail, n = ends(t, row["text"], row["final"], chunk, overlap, k == 0)
                for border, behind, ahead, rest in ((k, None if row["final"] else tail, None, n if row["final"] else 0), (k - 1, None, head, 0)):
                    if border >= 0:
                        for c, v in zip(out, (row["key"], border, behind and list(behind.items()) if behind is not None else None, ahead and list(ahead.items()) if ahead is not None else None, rest)):
                            out[c].append(v if v != {} else [])
            pairs = pa.map_(pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), (pa.int64(), pa.int32(), pairs, pairs, pa.int64()))], names=list(out))

    told = chunks.repartition("key", "number").mapInArrow(work, "key BIGINT, border INT, behind MAP<BIGINT, BIGINT>, ahead MAP<BIGINT, BIGINT>, rest BIGINT")
    pair = told.groupBy("key", "border").agg(F.first("behind", True).alias("behind"), F.first("ahead", True).alias("ahead"), F.sum("rest").alias("rest"))
    # the last chunk has nothing behind it, and its tokens all count
    pair = pair.withColumn("p", F.array_min(F.array_intersect(F.map_keys("behind"), F.map_keys("ahead"))))
    pair = pair.withColumn("n", F.when(F.col("behind").isNull(), F.col("rest")).otherwise(F.col("behind")[F.col("p")] - F.col("ahead")[F.col("p")]))
    return pair.groupBy("key").agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n"))


def _widened(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n) of texts by their chunks in order, with overlaps as wide as it takes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_of(path)
        rows = (row for batch in slices(batches) for row in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            key = row["key"]

            def parts() -> Iterator[str]:
                nonlocal row
                while row is not None and row["key"] == key:
                    yield row["text"] if row["final"] else row["text"][:chunk]
                    row = next(rows, None)

            n = spliced(t, parts(), overlap)
            yield pa.RecordBatch.from_pydict({"key": [key], "n": [n]})

    return chunks.repartition("key").sortWithinPartitions("key", "number").mapInArrow(work, "key BIGINT, n BIGINT")


def op12_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_counts(docs).withColumn("over_limit", F.col("n_tokens") > limit)
