"""Substring deduplication by repeated-phrase automata.

A window is 13 consecutive words of one document. A word goes if a window that covers it, as a
sequence of words, also starts in a document with a smaller ``doc_id``.

1. Anchors. Every window is represented by the smallest hash of the eight 6-word phrases in it, so
   equal windows have equal anchors. (anchor, doc_id) rows are counted; an anchor that occurs in
   one document only cannot belong to a recurring window.
2. Segments. Documents with recurring anchors emit the stretch of words of each run of windows
   with such an anchor, keyed by the anchor. Windows of very common anchors are keyed one by one
   by their own content and dealt over salts, more of them the more documents have the anchor; before
   the shuffle, their votes are merged per task.
3. Automata. Each task streams its segments in key order. Keys are gathered into shards of bounded
   size; in a shard the exact windows that occur in two documents are confirmed, compiled into an
   Aho-Corasick automaton (a word is one letter of the shard's own alphabet, or two past a million words) and every segment is
   run through it to locate every occurrence. Results are ranges of words per document.

No text meets more than the shards that can hold its phrases, so the work grows with the input.

Defined cases: a null text has no words; a null ``doc_id`` is neither smaller nor larger than any
other, so such rows lose nothing and cost others nothing (they are dealt by their text); rows that share a ``doc_id`` are judged
each by itself against smaller ids (they are told apart by a 32-bit hash of the text); an empty table gives an empty result. Further columns are left
alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.llm.shared import table
from sweepgrid.llm.words import Words, mix, ngrams, slices

WINDOW, PHRASE = 13, 6
#: Documents of one anchor from which its windows are keyed one by one and salted.
HOT_DOCS = 20_000
#: The salts of an anchor at that number, as a power of two; their number grows with the root of the
#: documents', so that neither the documents of a salt nor the votes sent to all salts grow with it.
SALT_BITS, MOST_BITS = 3, 20
#: Segments after which a shard is compiled.
SHARD_SEGMENTS = 20_000
#: Windows of one segment at most; longer runs are cut.
RUN = 64
#: Words of a shard that are one character: all but the surrogates and the last plane.
SINGLE = 0x100000 - 0x801
_WINDOW_SEED = np.uint64(0xA0761D6478BD642F)


def window_anchors(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window within one text, its anchor)."""
    h, left, span = words.hash, words.left(), window - phrase + 1
    g = ngrams(h, phrase)
    if len(g) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, width = g, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = np.flatnonzero(left[: len(least)] >= window)
    return at, least[at]


def runs(at: np.ndarray, anchor: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions in ``at`` where a run of neighbouring windows of one text with one anchor begins."""
    if not len(at):
        return np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    if length.max() > RUN:
        begin = np.concatenate([np.arange(b, b + n, RUN) for b, n in zip(begin, length)])
    return begin


def _anchors(window: int, phrase: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            at, anchor = window_anchors(words, window, phrase)
            owner = np.searchsorted(words.first, at, "right") - 1
            keep = runs(at, anchor, owner)
            ids = batch.column("doc_id").take(pa.array(owner[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[keep].view(np.int64)), ids], names=["h", "doc_id"])

    return work


_SEGMENT = pa.schema([("key", pa.int64()), ("phase", pa.int32()), ("doc_id", pa.int64()), ("last_id", pa.int64()), ("th", pa.int32()), ("start", pa.int32()), ("seg", pa.binary())])
SEGMENT = "key BIGINT, phase INT, doc_id BIGINT, last_id BIGINT, th INT, start INT, seg BINARY"
#: Votes of a salted window, segments that vote and are searched, salted windows that are only searched.
VOTE, BOTH, SEARCH = 0, 1, 2


def _segments(window: int, phrase: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(b.filter(pc.is_valid(b.column("doc_id"))) for b in batches):
            words = Words(batch.column("text"))
            at, anchor = window_anchors(words, window, phrase)
            owner = np.searchsorted(words.first, at, "right") - 1
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            ths = batch.column("th").to_numpy(zero_copy_only=False).astype(np.int64)
            out: list[tuple] = []
            votes: dict[tuple[int, bytes], list[int]] = {}
            wanted = np.zeros(len(at), np.int8)
            bits = np.zeros(len(at), np.int64)
            for name, mark in (("plain", 1), ("hot", 2)):
                lists = batch.column(name)
                flat = lists.flatten()
                if len(flat) and len(at):
                    # a set of (text, anchor) pairs, tested for all windows at once
                    of = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                    h = (flat if mark == 1 else flat.field("h")).to_numpy(zero_copy_only=False).astype(np.int64)
                    there = mix(h.view(np.uint64) + mix(of.astype(np.uint64)))
                    order = np.argsort(there)
                    mine = mix(anchor + mix(owner.astype(np.uint64)))
                    place = order[np.minimum(np.searchsorted(there, mine, sorter=order), len(there) - 1)]
                    found = there[place] == mine
                    wanted[found] = mark
                    if mark == 2:
                        bits[found] = flat.field("bits").to_numpy(zero_copy_only=False)[place[found]]
            pick = np.flatnonzero(wanted == 1)
            begin = pick[runs(at[pick], anchor[pick], owner[pick])] if len(pick) else pick
            length = np.diff(np.append(np.searchsorted(pick, begin), len(pick)))
            for i, n in zip(begin.tolist(), length.tolist()):
                a, o = int(at[i]), int(owner[i])
                out.append((int(anchor[i].view(np.int64)), BOTH, int(ids[o]), 0, int(ths[o]), a - int(words.first[o]), words.joined(a, a + n + window - 1)))
            pick = np.flatnonzero(wanted == 2)
            if len(pick):
                content = mix(ngrams(words.hash, window)[at[pick]] ^ _WINDOW_SEED)
                spread = mix(ids.view(np.uint64)).tolist()
                for i, c in zip(pick.tolist(), content):
                    a, o = int(at[i]), int(owner[i])
                    seg, doc = words.joined(a, a + window), int(ids[o])
                    salts = 1 << int(bits[i])
                    key = int(c) & 0x7FFFFFFFFFFFFFFF & -salts
                    out.append((key | (spread[o] & salts - 1), SEARCH, doc, 0, int(ths[o]), a - int(words.first[o]), seg))
                    vote = votes.setdefault((key, salts, seg), [doc, doc])
                    vote[0], vote[1] = min(vote[0], doc), max(vote[1], doc)
            every = chain(out, ((key | s, VOTE, low, high, 0, 0, seg) for (key, salts, seg), (low, high) in votes.items() for s in range(salts)))
            while part := list(islice(every, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), _SEGMENT)], schema=_SEGMENT)

    return work


def letter(n: int) -> str:
    """The n-th word of a shard as text: one character for the first million, two beyond. Leading and following
    characters of two are used for nothing else, so a match begins and ends with whole words."""
    if n < SINGLE:
        return chr(n + 1 if n < 0xD7FF else n + 0x801)
    lead, follow = divmod(n - SINGLE, 0x8000)
    return chr(0x100000 + lead) + chr(0x108000 + follow)


class Shard:
    """Segments of some keys; ``compile`` confirms the windows that recur and builds the automaton."""

    def __init__(self, window: int):
        self.window = window
        self.alphabet: dict[bytes, str] = {}
        self.texts: dict[bytes, list[tuple[int, int, int]]] = {}
        self.seen: dict[str, list[int]] = {}
        self.automaton = None

    def letters(self, seg: bytes) -> list[str]:
        out = []
        for w in seg.split(b" "):
            c = self.alphabet.get(w)
            if c is None:
                c = self.alphabet[w] = letter(len(self.alphabet))
            out.append(c)
        return out

    def vote(self, seg: bytes, low: int, high: int) -> None:
        words, n = self.letters(seg), self.window
        s = "".join(words)
        single = len(s) == len(words)
        for i in range(len(words) - n + 1):
            v = self.seen.get(w := s[i : i + n] if single else "".join(words[i : i + n]))
            if v is None:
                self.seen[w] = [low, high]
            else:
                if low < v[0]:
                    v[0] = low
                if high > v[1]:
                    v[1] = high

    def add(self, seg: bytes, doc: int, th: int, start: int) -> None:
        self.texts.setdefault(seg, []).append((doc, th, start))

    def compile(self) -> None:
        for seg, where in self.texts.items():
            ids = [x[0] for x in where]
            self.vote(seg, min(ids), max(ids))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        for w, (low, high) in self.seen.items():
            if low < high:
                self.automaton.add_word(w, low)
        self.seen.clear()
        if len(self.automaton):
            self.automaton.make_automaton()

    def locate(self, seg: bytes, where: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(doc, th, first word, after the last word) of what goes in each place of a segment."""
        if not len(self.automaton):
            return
        n, words = self.window, self.letters(seg)
        s = "".join(words)
        hits = [(end - n + 1, first) for end, first in self.automaton.iter(s)]
        if not hits:
            return
        if len(s) > len(words):
            ends = {end: k for k, end in enumerate(accumulate(map(len, words)))}
            hits = [(ends[at + n] - n + 1, first) for at, first in hits]
        lowest = min(f for _, f in hits)
        for doc, th, start in where:
            if doc <= lowest:
                continue
            a = b = None
            for at, first in hits:
                if first >= doc:
                    continue
                if a is None:
                    a, b = at, at + n
                elif at <= b:
                    b = at + n
                else:
                    yield doc, th, start + a, start + b
                    a, b = at, at + n
            if a is not None:
                yield doc, th, start + a, start + b


_RANGE = pa.schema([("doc_id", pa.int64()), ("th", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])


def _locate(window: int, shard_segments: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, key, searched, out = Shard(window), 0, None, False, []

        def found() -> list[tuple]:
            shard.compile()
            return [x for seg, where in shard.texts.items() for x in shard.locate(seg, where)]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _RANGE)], schema=_RANGE)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "phase", "doc_id", "last_id", "th", "start", "seg")]
            for k, phase, doc, last, th, start, seg in zip(*columns):
                if k != key:
                    if size >= shard_segments or searched:
                        if not searched:
                            out += found()
                        shard, size, searched = Shard(window), 0, False
                    key = k
                if phase == SEARCH:
                    if not searched:
                        out += found()
                        shard.texts.clear()
                        searched = True
                    out += shard.locate(seg, [(doc, th, start)])
                elif phase == VOTE:
                    shard.vote(seg, doc, last)
                    size += 1
                else:
                    shard.add(seg, doc, th, start)
                    size += 1
            if len(out) >= 10_000:
                yield packed(out)
                out = []
        if size and not searched:
            out += found()
        if out:
            yield packed(out)

    return work


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(batch.column("text"))
        texts = batch.column("text")
        ids, ths, ranges = batch.column("doc_id"), batch.column("th").to_pylist(), batch.column("ranges")
        gone, digest, kept_text = [], [], []
        for d in range(batch.num_rows):
            first, n = int(words.first[d]), int(words.count[d])
            mine = [(r["a"], r["b"]) for r in (ranges[d].as_py() or ()) if r["th"] == ths[d] and ids[d].is_valid]
            if mine:
                keep = np.ones(n, bool)
                for a, b in mine:
                    keep[a:b] = False
                w = words.text(first, first + n).split()
                kept = b" ".join([w[i] for i in np.flatnonzero(keep).tolist()])
                gone.append(n - int(keep.sum()))
            else:
                kept = b" ".join((texts[d].as_py() or "").encode().split()) if n else b""
                gone.append(0)
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode())
        yield pa.RecordBatch.from_arrays([ids, pa.array(words.count.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(digest), pa.array(kept_text)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, hot_docs: int = HOT_DOCS, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    # The key is never null, so that no filter on it keeps the two joins from sharing one exchange
    # of the texts; the same goes for the anchors, dealt once for their counts and the join. Rows
    # without an id are dealt by their text; what they happen to meet is not theirs and left alone.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(text)).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    anchors = rows.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_anchors(window, phrase), "h BIGINT NOT NULL, doc_id BIGINT NOT NULL").repartition("h")
    recurring = anchors.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    more = F.least(F.floor(F.log2(F.col("n") / hot_docs) / 2), F.lit(MOST_BITS - SALT_BITS)).cast("int")
    recurring = recurring.select("h", F.when(F.col("n") > hot_docs, SALT_BITS + more).alias("bits"))
    of_doc = anchors.join(recurring, "h").groupBy(F.col("doc_id").alias("key")).agg(
        F.collect_set(F.when(F.col("bits").isNull(), F.col("h"))).alias("plain"),
        F.collect_set(F.when(F.col("bits").isNotNull(), F.struct("h", "bits"))).alias("hot"),
    )
    segments = rows.join(of_doc, "key").select("doc_id", F.hash("text").alias("th"), "text", "plain", "hot").mapInArrow(_segments(window, phrase), SEGMENT)
    ranges = segments.repartition("key").sortWithinPartitions("key", "phase").mapInArrow(_locate(window, shard_segments), "doc_id BIGINT NOT NULL, th INT, a INT, b INT")
    of_doc = ranges.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("th", "a", "b")).alias("ranges"))
    joined = rows.join(of_doc, "key", "left").select("doc_id", F.hash("text").alias("th"), "text", "ranges")
    return joined.mapInArrow(_cut, "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept_sha256 STRING, kept_text STRING")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")
