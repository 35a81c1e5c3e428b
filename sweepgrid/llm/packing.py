"""Packing token streams into sequences: concatenate and cut.

Pass one tokenises each input partition once and writes, per document, its ids and where it begins
within its partition. A prefix sum over the partitions' token totals (a row per partition) gives
each partition's global offset. Pass two adds that offset and cuts every document at multiples of
the sequence length, so each piece and its place follow from the row alone: nothing is gathered,
and a repeated task gives the same pieces because the first pass is read from a written table.

Defined cases: a null text is empty and still has the end id; white space between words never
reaches the tokenizer, which drops it; rows with null or repeated ``doc_id`` are documents of
their own; an empty table gives no pieces. Further columns are left alone.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sweepgrid.llm.shared import handing_back, materialise, table
from sweepgrid.llm.words import slices

#: Parts of words whose ids a worker keeps; beyond that, only those of the slice at hand stay.
CACHE_WORDS = 400_000
#: Bytes of text encoded at once: the more, the fewer distinct words are looked up again.
SLICE_BYTES = 6 << 20


#: Partitions up to which their offsets are broadcast.
BROADCAST_PARTS = 500_000


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_ALPHABET = _alphabet()
_ID = attrgetter("id")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def plain_letters() -> str:
    """A character class of the letters that stay as they are when a text is composed and lowered.

    Only characters that were letters in Unicode 3.2 already, so that no version in use differs.
    """
    old, out, begin = unicodedata.ucd_3_2_0, [], None
    for c in range(0x10000):
        x = chr(c)
        good = old.category(x)[0] == unicodedata.category(x)[0] == "L" and x.lower() == x and unicodedata.normalize("NFC", x) == x
        if good and begin is None:
            begin = x
        elif not good and begin is not None:
            out.append(f"{begin}-{chr(c - 1)}")
            begin = None
    return "".join(out)


class WordTokenizer:
    """Ids of whole texts from a tokenizer whose pieces never cross ASCII white space.

    Texts are split at white space, each distinct word is encoded once, and ids are laid out by
    array operations. A word is taken apart further where its pieces are sure to part: a tail of
    ASCII punctuation after an ASCII digit or one of ``plain_letters``; the parts are what is kept. Words of ASCII characters are
    lowered first, as the tokenizer does; others are not, as composing comes before lowering. Words
    that may hold a special token are left as they are. Words of plain letters only, composed, are
    one piece for the tokenizer and go to its model directly, as bytes in its alphabet; whether
    that gives the same ids is tried on a few words first. ``encode`` is the same as encoding each
    text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        probe = ("a", "lower", "été", "straße", "漢字", "слово", "ñandú", "x" * 40)
        self.direct = all([t.id for t in found] == self.tokenizer.encode(w, add_special_tokens=False).ids for w, found in zip(probe, self._direct(probe)))
        self.letters = re.compile(f"[{plain_letters()}]+").fullmatch
        self.parts_after = re.compile(f"[0-9{plain_letters()}]").fullmatch
        self.known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.ids, self.start, self.size, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 0

    def _put(self, words: Sequence[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.known), len(words)
        while k + n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + n] = sizes
        self.known.update(zip(words, range(k, k + n)))
        self.used += len(ids)

    def _direct(self, words: Sequence[str]) -> list[list]:
        """The model's tokens of words that are one piece each."""
        return [self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_ALPHABET)) for w in words]

    def _learn(self, words: list[str]) -> None:
        letters, other = [], []
        for w in words:
            plain = self.direct and (w.isascii() and w.isalpha() or self.letters(w) and unicodedata.is_normalized("NFC", w))
            (letters if plain else other).append(w)
        for begin in range(0, len(letters), 2000):
            part = letters[begin : begin + 2000]
            found = self._direct(part)
            self._put(part, np.fromiter(map(_ID, chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        for begin in range(0, len(other), 2000):
            part = other[begin : begin + 2000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._put(part, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _parted(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, list[str]]:
        """(each word without the tail that is sure to part, which words have one, those tails)."""
        special = pc.match_substring(words, "<|")
        words = pc.if_else(pc.or_(special, pc.invert(pc.string_is_ascii(words))), words, pc.ascii_lower(words))
        core = pc.ascii_rtrim(words, string.punctuation)
        last = pc.utf8_slice_codeunits(core, -1).dictionary_encode()
        parts = np.array([self.parts_after(c) is not None for c in last.dictionary.to_pylist()], bool)[np.asarray(last.indices)]
        cut = parts & np.asarray(pc.less(pc.binary_length(core), pc.binary_length(words))) & ~np.asarray(special)
        core, at = pc.if_else(pa.array(cut), core, words), pa.array(np.flatnonzero(cut))
        return core, cut, [w[len(c) :] for w, c in zip(words.take(at).to_pylist(), core.take(at).to_pylist())]

    def _slots(self, words: list[str]) -> np.ndarray:
        """Where the ids of each distinct part are kept; those of new ones are found first."""
        slots = list(map(self.known.get, words))
        missing = [w for w, k in zip(words, slots) if k is None]
        if not missing:
            return np.array(slots, np.int64)
        if len(self.known) + len(missing) > CACHE_WORDS:
            # words that have come back stay, the others go
            kept = [(w, k) for w, k in zip(words, slots) if k is not None]
            of = np.array([k for _, k in kept], np.int64)
            ids, sizes = _laid(self.ids, self.start[of], self.size[of]), self.size[of]
            self._clear()
            self._put([w for w, _ in kept], ids, sizes)
        self._learn(missing)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids in each text)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        at = np.asarray(lists.offsets).astype(np.int64)
        at = at - at[0]
        coded = lists.flatten().dictionary_encode()
        core, cut, tails = self._parted(coded.dictionary)
        parts = pa.concat_arrays([core, pa.array(tails, core.type)]).dictionary_encode()
        slots = self._slots(parts.dictionary.to_pylist())[np.asarray(parts.indices)]
        # the ids of each distinct word: its core's, and its tail's where it has one
        place = np.arange(len(core)) + np.cumsum(cut) - cut
        own = np.empty(len(slots), np.int64)
        own[place], own[place[cut] + 1] = slots[: len(core)], slots[len(core) :]
        word_ids, size = _laid(self.ids, self.start[own], self.size[own]), self.size[slots[: len(core)]].astype(np.int64)
        size[cut] += self.size[slots[len(core) :]]
        words = np.asarray(coded.indices)
        sums = np.concatenate([[0], np.cumsum(size[words])])
        per_text = np.diff(sums[at])
        ids = _laid(word_ids, (np.cumsum(size) - size)[words], size[words])
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(per_text), np.uint32(end_id))
            per_text = per_text + 1
        return ids, per_text


def _laid(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``ids``, one after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at))
    return ids[at]


@cache
def encoder_of(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker."""
    return WordTokenizer(path)


def tokenised(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """Written table of (part, begin, n, ids little-endian unsigned 32 bit, doc_id, carried columns)."""
    path = tokenizer or default_tokenizer()
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "part INT, begin BIGINT, n BIGINT, ids BINARY, " + ", ".join(f"`{c}` {fields[c]}" for c in carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = encoder_of(path), TaskContext.get().partitionId(), 0
        # what it has learned goes with the task: a worker waits for its next one with empty hands
        encoder._clear()
        for batch in slices(batches, "__text", SLICE_BYTES):
            ids, sizes = encoder.encode(batch.column("__text"), end_id)
            ends = np.cumsum(sizes)
            raw = ids.astype("<u4").tobytes()
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes()), pa.py_buffer(raw)])
            columns = [pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + ends - sizes), pa.array(sizes), packed]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in carry], names=["part", "begin", "n", "ids", *carry])
            at += int(ends[-1])
        batch = ids = packed = columns = None
        encoder._clear()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")
    return materialise(docs.select(*[F.col(f"`{c}`") for c in carry], text).mapInArrow(handing_back(work), schema.rstrip(", ")), "tokens")


def offsets(tokens: DataFrame) -> DataFrame:
    """Each document's global offset: prefix sums over the partitions' totals, a row per partition."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = materialise(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")), "offsets")
    # a row per partition: broadcast while that is small, else joined by key
    side = F.broadcast(base) if base.count() <= BROADCAST_PARTS else base
    return tokens.join(side, "part").withColumn("at", F.col("base") + F.col("begin")).drop("base", "begin", "part")


def pieces(tokens: DataFrame, length: int = 2048, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Cut each document at multiples of ``length`` of the global stream; one row per piece."""
    types = {f.name: f.dataType.simpleString() for f in tokens.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in carry) + ", start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT, ids BINARY"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            at, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
            count = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = at[row] // length + k
            begin = np.maximum(at[row], sequence * length)
            size = np.minimum(at[row] + n[row], (sequence + 1) * length) - begin
            start = begin - at[row]
            ids = batch.column("ids")
            data, last, raw = [], -1, b""
            for r, a, s in zip(row.tolist(), start.tolist(), size.tolist()):
                if r != last:
                    last, raw = r, memoryview(ids[r].as_buffer())
                data.append(bytes(raw[4 * a : 4 * (a + s)]))
            columns = [batch.column(c).take(pa.array(row)) for c in carry]
            columns += [pa.array(x) for x in (start, size, np.fromiter(map(zlib.crc32, data), np.int64, len(data)), n[row], sequence, begin - sequence * length)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], names=[*carry, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return offsets(tokens).select("at", "n", "ids", *[F.col(f"`{c}`") for c in carry]).mapInArrow(handing_back(work), schema)


def packed(docs: DataFrame, length: int = 2048, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Pieces of every document with the ids they hold."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return pieces(tokenised(docs, tokenizer, end_id, ("doc_id",)), length)


def sequences(pieces_: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array, n, padded): whole sequences; the last is padded to ``length`` unless
    the number of its ids is a power of two. One sequence gathers at most ``length`` ids."""

    def work(keys: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("offset")
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), "<u4")
        n = len(ids)
        full = n if n & (n - 1) == 0 else length
        out = np.concatenate([ids, np.full(full - n, pad_id, np.uint32)]).astype(np.int64)
        return pa.table({"sequence_id": [keys[0].as_py()], "ids": pa.array([out.tolist()], pa.list_(pa.int64())), "n": [n], "padded": [full - n]})

    return pieces_.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(work, "sequence_id BIGINT, ids ARRAY<BIGINT>, n BIGINT, padded BIGINT")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).drop("ids")
