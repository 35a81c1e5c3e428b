"""Periodic runs of words, found whole by the method of Kolpakov and Kucherov, and texts without their repeats.

A run is a stretch of consecutive words that has a smallest period q, is as long as ``least`` words and
2 q, and cannot be extended by a neighbouring word without losing the period. ``maximal_runs`` cuts a
sequence into factors that occur before (LZ, from a suffix automaton), finds the runs that touch each
border of factors by Main's algorithm, in time that is linear in the factors beside the border, and
copies the runs that lie strictly inside a factor from the factor's earlier occurrence.

Which words a run can hold at all is seen first, by array operations over many texts: a run of 12
words or more repeats each of its 6-grams within itself, so it lies whole in one stretch of words that
are covered by 6-grams which that stretch holds twice. Stretches are narrowed until they stay as they
are, which drops no run, and only they are searched. Words are compared as bytes there, not by hash.

Rows are independent, so there is no shuffle, and a lost task is simply run again. Defined cases: a null
or blank text has no words and no runs; white space is 0x20 and 0x09 to 0x0D; ties, repeated rows and
null ids need no rule, as each row is on its own; an empty table gives an empty table; further columns
of any name pass through. A text is searched within one task: memory follows the longest stretch (about
1 KB a word), not the partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.llm.shared import table, unused
from sweepgrid.llm.words import Words, mix, ngrams, slices

#: Shortest run, in words.
LEAST = 12
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _automaton(s: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Suffix automaton: the transitions of each state and where the first occurrence of its strings ends."""
    step, link, size, first = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(step[q].copy())
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step, first


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """LZ factors (begin, end, begin of an earlier occurrence or -1), each as long as it can be."""
    step, first = _automaton(s)
    out, i, n = [], 0, len(s)
    while i < n:
        state, j = 0, i
        while j < n and (t := step[state][s[j]]) and first[t] < j:
            state, j = t, j + 1
        if j == i:
            out.append((i, i + 1, -1))
            i += 1
        else:
            out.append((i, j, first[state] - (j - i) + 1))
            i = j
    return out


def _z(s: list[int]) -> list[int]:
    """For each position, how far the sequence from there agrees with the whole."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _touching(s: list[int], c: int, end: int, reach: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Repetitions (begin, end, period) that touch the border ``c`` from either side, end by ``end`` and begin
    within ``reach`` before ``c``; Main's algorithm."""
    base = max(0, c - reach - 1)
    left, right = s[base:c], s[c : end + 1]
    n, m = len(left), len(right)
    ahead = _z([*right, -2, *left, *right])
    behind = _z([*left[::-1], -2, *right[::-1], *left[::-1]])
    for p in range(1, m):  # a period lies right of the border
        more, before = ahead[m + 1 + n + p], behind[n + 1 + m - p]
        if more + before >= p and p + more + before >= least:
            a, b = c - before, c + p + more
            if b <= end and (a > base or base == 0):
                yield a, b, p
    for p in range(1, n + 1):  # a period lies left of it
        more, before = ahead[m + 1 + n - p], behind[p] if p < n else 0
        more, before = min(more, m), min(before, n - p)
        if more + before >= p and p + more + before >= least:
            a, b = c - p - before, c + more
            if b <= end and (a > base or base == 0):
                yield a, b, p


def maximal_runs(s: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of ``least`` items or more, by start, then period; items are >= 0."""
    s = [*s, -1]  # a last factor of its own, so that every factor has a border behind it
    found: dict[tuple[int, int], int] = {}
    at: dict[int, list[tuple[int, int]]] = {}

    def put(a: int, b: int, p: int) -> None:
        if b - a >= max(least, 2 * p) and p < found.get((a, b), p + 1):
            if (a, b) not in found:
                at.setdefault(a, []).append((b, p))
            found[a, b] = p

    cut = factors(s)
    for k, (c, end, source) in enumerate(cut):
        if k:
            before = c - cut[k - 1][0]
            # a new run that ends in this factor is shorter than twice both factors
            if 2 * (before + end - c) > least:
                for run in _touching(s, c, end, 2 * before + end - c, least):
                    put(*run)
        if source >= 0 and end - c > least:
            shift = c - source
            for j in range(c + 1, end - least):
                for b, _ in at.get(j - shift, ())[:]:
                    if b + shift < end:
                        put(j, b + shift, found[j - shift, b])
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def stretches(h: np.ndarray, first: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [a, b) of the word hashes ``h`` that hold every run; text d has the words first[d] to first[d + 1]."""
    n, g = len(h), least // 2
    if n < least:
        return []
    grams = ngrams(h, g)
    begin, end = first[:-1], first[1:]
    while True:
        long = end - begin >= least
        begin, end = begin[long], end[long]
        if not len(begin):
            return []
        size = end - begin - g + 1
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        label = np.repeat(np.arange(len(begin), dtype=np.uint64), size)
        key = mix(grams[at] + label * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        # words covered by such grams; stretches of one text or stretch never run into the next
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + g, -1)
        covered = np.cumsum(edge[:-1]) > 0
        cut = np.zeros(n + 1, dtype=bool)
        cut[begin] = cut[end] = True
        open_ = covered & (cut[:-1] | ~np.concatenate([[False], covered[:-1]]))
        close = covered & (cut[1:] | ~np.concatenate([covered[1:], [False]]))
        a, b = np.flatnonzero(open_), np.flatnonzero(close) + 1
        if len(a) == len(begin) and (a == begin).all() and (b == end).all():
            return list(zip(a.tolist(), b.tolist()))
        begin, end = a, b


def runs_in(texts: pa.Array, least: int = LEAST) -> tuple[list[list[tuple[int, int, int]]], list[int], list[bytes]]:
    """Of each text: its runs, the number of its words, and its words but for repeats, joined by one space."""
    w = Words(texts)
    out: list[list] = [[] for _ in range(len(texts))]
    for a, b in stretches(w.hash, w.first, least):
        known: dict[bytes, int] = {}
        ids = [known.setdefault(x, len(known)) for x in w.text(a, b).split()]
        d = int(np.searchsorted(w.first, a, "right")) - 1
        while w.first[d + 1] <= a:
            d += 1
        off = a - int(w.first[d])
        out[d] += [(off + x, n, p) for x, n, p in maximal_runs(ids, least)]
    kept = []
    for d, found in enumerate(out):
        words = w.raw[w.at[d] : w.at[d + 1]].tobytes().split()
        if found:
            found.sort(key=lambda r: (r[0], r[2]))
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            for start, length, period in found:
                edge[start + period] += 1
                edge[start + length] -= 1
            words = [x for x, drop in zip(words, np.cumsum(edge).tolist()) if not drop]
        kept.append(b" ".join(words))
    return out, w.count.tolist(), kept


def with_runs(docs: DataFrame, least: int = LEAST, runs: str = "runs", words: str = "n_words", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with an array of their runs (start, length, period), their words, and their text without repeats."""
    carry = [c for c in docs.columns if c != "text"]
    text, r, n, c = unused(docs.columns, "text_", "runs_", "words_", "collapsed_")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{x}` {fields[x]}" for x in carry), f"`{r}` ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>", f"`{n}` BIGINT", f"`{c}` STRING"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found, count, kept = runs_in(batch.column(text), least)
            columns = [batch.column(x) for x in carry]
            columns += [pa.array([[dict(zip(("start", "length", "period"), x)) for x in f] for f in found], _RUN), pa.array(count, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, r, n, c])

    narrow = docs.select(*[F.col(f"`{x}`") for x in carry], F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    return narrow.mapInArrow(work, schema).withColumnsRenamed({r: runs, n: words, c: collapsed})


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32 of the decimal doc_id, every text with h % 10 = 0 repeats a part of itself
    from word (h div 10) % n on to its end. Its words are then joined by one space; the others stay as they are.
    Without an id nothing is repeated."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts, out = batch.column("doc_id").to_pylist(), batch.column("text"), []
            for k, i in enumerate(ids):
                h = zlib.crc32(str(i).encode()) if i is not None else 1
                text = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
                if h % 10 == 0 and (words := text.split()):
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join(words[:a] + [words[a + x % p] for x in range(n - a)])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, f"doc_id {kind}, text STRING")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(with_periodic_ends(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    line = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
