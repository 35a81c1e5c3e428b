"""Language-model scores by deleted interpolation.

A bigram model: P(w | v) = a_b c(v w) / c(v) + b_b c(w) / N + c_b / (V + 1), whose weights depend on
the bucket b of the context's frequency c(v). Each longer order is interpolated with the one below:
P(w | u v) = l_b c(u v w) / c(u v) + (1 - l_b) P(w | v), where b is the bucket of c(u v), and so on;
contexts are padded with begin marks. Counts come from all training documents; the weights are
learned by expectation-maximisation on the n-grams of a fold that is deleted from the counts, from
the shortest order to the longest.

Documents are dealt into groups by a hash of their content. A group sends the distinct hashes of its
words and n-grams, each with its counts, to the shard of the hash (orders above two in rounds of
their own, so that only one round's hashes are on disk); shards add up over all groups and
send each group the totals of what it asked for. A group has a row for each shard that holds keys of
it, so rows are never more than the distinct keys of all groups, whatever the number of shards. Rows are blobs of sorted, delta-coded hashes, so
counts of the whole corpus move in about six bytes per distinct hash and group, and a frequent word
is one entry per group, never a group of rows.

Hashes have 56 bits: at 10**9 distinct bigrams about seven are counted together with another.

Defined cases: a null text is empty, a null ``doc_id`` counts as the text "" and so is held out;
rows with repeated ids are documents of their own; with no training tokens the base score uses
N = V = 0 and the model is uniform; an empty table gives an empty result. Further columns are left
alone.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.llm.shared import materialise, shuffle_files_dropped, table, text_bytes
from sweepgrid.llm.words import Words, mix, slices

FOLDS, HELD_OUT, TUNED_ON = 10, 0, 1
#: Bytes of text in a group of documents and behind a shard of hashes.
GROUP_BYTES, SHARD_BYTES = 5 << 20, 10 << 20
#: Upper bounds of context frequency of each bucket but the last; bucket 0 is the unseen context.
BUCKETS = np.array([0, 1, 2, 4, 8, 16, 64, 256, 1024, 8192, 65536, 1 << 20], np.int64)
#: Steps of the logarithm of a probability in the sufficient statistics, and how many there are.
STEP, STEPS = 0.25, 96
_KEY_BITS = 56
_END, _BEGIN = np.uint64(0x51ED270B0F1A2C35), np.uint64(0x2545F4914F6CDD1D)
WORD, BIGRAM = 0, 1
#: Words of the longest n-gram in the query.
ORDER = 3


def folds(ids: pa.Array) -> np.ndarray:
    """crc32 of the id as text, modulo ten."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids.to_pylist()), np.int64, len(ids))


class Tokens:
    """N-gram hashes by kind (words, bigrams, ...) of some documents; each ends with an end token and starts after begin marks."""

    def __init__(self, texts: pa.Array, order: int = 2):
        # words are hashed a slice at a time, as that takes many times the bytes of the text
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for piece in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
            words = Words(piece.column("text"), lower=True)
            hashes.append(words.hash)
            counts.append(words.count)
        self.count = np.concatenate(counts) + 1
        ends = np.cumsum(self.count) - 1
        self.begins = ends - self.count + 1
        word = np.empty(int(self.count.sum()), np.uint64)
        inner = np.ones(len(word), bool)
        inner[ends] = False
        word[inner] = np.concatenate(hashes)
        word[ends] = _END
        self.grams = [word]
        for _ in range(1, order):
            self.grams.append(mix(self.shifted(self.grams[-1], _BEGIN) * np.uint64(0x9E3779B97F4A7C15) + word))
        self.document = np.repeat(np.arange(len(self.count)), self.count)
        self.grams = [g >> np.uint64(64 - _KEY_BITS) for g in self.grams]

    def shifted(self, values: np.ndarray, begin: np.generic) -> np.ndarray:
        """The value of the token before each; ``begin`` for the first of a document."""
        before = np.empty_like(values)
        before[1:] = values[:-1]
        before[self.begins] = begin
        return before


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of as many bytes as the largest needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those of 255 and more follow in eight, packed once more where they are many."""
    large = counts >= 255
    raw = np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()
    return b"1" + zlib.compress(raw, 1) if len(raw) > 64 else b"0" + raw


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(blob[1:]) if blob[:1] == b"1" else blob[1:]
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    large = out == 255
    out[large] = np.frombuffer(raw, "<i8", offset=n)
    return out


_ASK = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("main", pa.binary()), ("fold", pa.binary())])
ASK = "kind INT, shard INT, bucket BIGINT, n BIGINT, keys BINARY, main BINARY, fold BINARY"
_TOLD = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("main", pa.binary()), ("fold", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("main_tokens", pa.int64()), ("main_distinct", pa.int64())])
TOLD = "bucket BIGINT, kind INT, shard INT, n BIGINT, main BINARY, fold BINARY, tokens BIGINT, distinct BIGINT, main_tokens BIGINT, main_distinct BIGINT"


def _distinct(tokens: Tokens, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, place of each token's key among them); begin marks count as words of their own."""
    if kind != WORD:
        return np.unique(tokens.grams[kind], return_inverse=True)
    starts = np.full(len(tokens.count), _BEGIN >> np.uint64(64 - _KEY_BITS), np.uint64)
    return np.unique(np.concatenate([tokens.grams[WORD], starts]), return_inverse=True)


def _ask(shards: int, kinds: tuple[int, ...]):
    shift = np.uint64(_KEY_BITS - (shards - 1).bit_length())

    def work(keys: tuple, t: pa.Table) -> pa.Table:
        tokens, fold = Tokens(t.column("text").combine_chunks(), max(kinds) + 1), folds(t.column("doc_id"))
        rows = []
        for kind in kinds:
            unique, place = _distinct(tokens, kind)
            of = fold[tokens.document] if kind != WORD else np.concatenate([fold[tokens.document], fold])
            main = np.bincount(place[(of != HELD_OUT) & (of != TUNED_ON)], minlength=len(unique))
            tuned = np.bincount(place[of == TUNED_ON], minlength=len(unique))
            # a row for each shard that has keys of the group: never more rows than keys, however many shards there are
            shard = (unique >> shift).astype(np.int64)
            cut = np.flatnonzero(np.diff(shard, prepend=-1, append=shards)).tolist()
            rows += [(kind, int(shard[a]), keys[0].as_py(), b - a, pack_keys(unique[a:b]), pack_counts(main[a:b]), pack_counts(tuned[a:b])) for a, b in zip(cut, cut[1:])]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ASK)], schema=_ASK) if rows else _ASK.empty_table()

    return work


def _tell(keys: tuple, t: pa.Table) -> pa.Table:
    """Totals of a shard for each group that asked, and one row with the shard's own totals."""
    kind, shard = keys[0].as_py(), keys[1].as_py()
    n = t.column("n").to_pylist()
    ask = [np.concatenate(x) for x in zip(*((unpack_keys(k), unpack_counts(m, i), unpack_counts(f, i)) for k, m, f, i in zip(*(t.column(c).to_pylist() for c in ("keys", "main", "fold")), n)))]
    order = np.argsort(ask[0], kind="stable")
    ordered = ask[0][order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    main, fold = np.add.reduceat(ask[1][order], at), np.add.reduceat(ask[2][order], at)
    rows, begin = [], 0
    for bucket, size in zip(t.column("bucket").to_pylist(), n):
        mine = place[begin : begin + size]
        rows.append((bucket, kind, shard, size, pack_counts(main[mine]), pack_counts(fold[mine]), None, None, None, None))
        begin += size
    own = ordered[at] != (_BEGIN >> np.uint64(64 - _KEY_BITS)) if kind == WORD else np.zeros(len(at), bool)
    both = (main + fold)[own]
    rows.append((-1, kind, shard, 0, None, None, int(both.sum()), int((both > 0).sum()), int(main[own].sum()), int((main[own] > 0).sum())))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _TOLD)], schema=_TOLD)


class Counts:
    """Totals of a group's tokens in the main part and in the fold: (n-grams by kind, contexts by kind from bigrams on)."""

    def __init__(self, tokens: Tokens, told: pa.Table):
        got = {(k, s): (n, m, f) for k, s, n, m, f in zip(*(told.column(c).to_pylist() for c in ("kind", "shard", "n", "main", "fold")))}
        n, begin = len(tokens.grams[WORD]), ()
        both: tuple = ([], []), ([], [])
        for kind in range(len(tokens.grams)):
            unique, place = _distinct(tokens, kind)
            parts = [got[k] for k in sorted(got) if k[0] == kind]
            if sum(p[0] for p in parts) != len(unique):
                raise ValueError("a group's counts are incomplete")
            totals = [np.concatenate([unpack_counts(p[i], p[0]) for p in parts]) if parts else np.zeros(0, np.int64) for i in (1, 2)]
            if kind == WORD:
                begin = [t[place[n]] for t in totals]
            for (grams, contexts), t, b in zip(both, totals, begin):
                if kind != WORD:
                    contexts.append(tokens.shifted(grams[-1], b))
                grams.append(t[place[:n]])
        self.main, self.fold = both


def _bucket(contexts: np.ndarray) -> np.ndarray:
    return np.searchsorted(BUCKETS, contexts)


def _level(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else 1 and more by the size of -ln p."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(1 + np.floor(-np.log(np.maximum(p, 1e-300)) / STEP), STEPS - 1), 0).astype(np.int64)


def interpolated(counts: tuple, n: int, distinct: int, weights: np.ndarray, longer: list[np.ndarray]) -> np.ndarray:
    """Probability of each token by the weights of the bigram model and those of each longer order."""
    (word, pair, *grams), (context, *contexts) = counts
    b = _bucket(context)
    p = weights[b, 0] * pair / np.maximum(context, 1) + weights[b, 1] * word / max(n, 1) + weights[b, 2] / (distinct + 1)
    for share, gram, context in zip(longer, grams, contexts):
        w = share[_bucket(context)]
        p = w * gram / np.maximum(context, 1) + (1 - w) * p
    return p


def _statistics(n_main: int, distinct: int = 0, weights: np.ndarray | None = None, longer: tuple = ()):
    """Counts of the fold's n-grams by context bucket and by the levels of the estimates of the order and of the one below.

    Bigrams without ``weights``, else the order above those of ``weights`` and ``longer``.
    """
    order = 2 if weights is None else 3 + len(longer)

    def work(keys: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])
        if not docs.num_rows:
            return schema.empty_table()
        tokens = Tokens(docs.column("text").combine_chunks(), order)
        pick = (folds(docs.column("doc_id")) == TUNED_ON)[tokens.document]
        grams, contexts = ([c[pick] for c in x] for x in Counts(tokens, told).main)
        below = grams[WORD] / max(n_main, 1) if weights is None else interpolated((grams, contexts), n_main, distinct, weights, longer)
        cell = (_bucket(contexts[-1]) * STEPS + _level(grams[-1] / np.maximum(contexts[-1], 1))) * STEPS + _level(below)
        cells, n = np.unique(cell, return_counts=True)
        return pa.Table.from_arrays([pa.array(cells), pa.array(n)], schema=schema)

    return work


def _parts(cells: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(context bucket, probabilities of both estimates) of each cell; a level stands for the middle of its step."""
    return cells // (STEPS * STEPS), [np.where(x > 0, np.exp(-(x - 0.5) * STEP), 0.0) for x in (cells // STEPS % STEPS, cells % STEPS)]


def _fit(q: np.ndarray, weight: np.ndarray, w: np.ndarray, rounds: int) -> np.ndarray:
    """Mixture weights of the columns of ``q`` by expectation-maximisation from ``w``."""
    if not weight.sum():
        return w
    for _ in range(rounds):
        share = q * w
        share *= (weight / share.sum(1))[:, None]
        w = share.sum(0) / weight.sum()
        w = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
    return w


def learn(cells: np.ndarray, n: np.ndarray, distinct: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, estimate: bigram, word, uniform) by expectation-maximisation.

    Buckets without data, and those of unseen contexts, take the pooled weights with the bigram's
    share moved to the word's.
    """
    bucket, p = _parts(cells)
    q = np.stack([*p, np.full(len(cells), 1.0 / (distinct + 1))], 1)
    fit = lambda mask: _fit(q[mask], n[mask].astype(float), np.array([0.3, 0.6, 0.1]), rounds)
    pooled = fit(np.ones(len(cells), bool))
    out = np.empty((len(BUCKETS) + 1, 3))
    for b in range(len(out)):
        out[b] = fit(bucket == b) if (bucket == b).any() else pooled
    out[0] = [0.0, out[0, 0] + out[0, 1], out[0, 2]]
    return out


def learn_longer(cells: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Share of a longer order's own estimate by bucket; none in unseen contexts, the pooled one in buckets without data."""
    bucket, p = _parts(cells)
    q = np.stack(p, 1)
    fit = lambda mask: _fit(q[mask], n[mask].astype(float), np.array([0.5, 0.5]), rounds)[0]
    pooled = fit(bucket > 0)
    out = np.array([fit(bucket == b) if (bucket == b).any() else pooled for b in range(len(BUCKETS) + 1)])
    out[0] = 0.0
    return out


def _score(tokens_n: int, distinct: int, weights: list, longer: list):
    w, higher = np.array(weights), [np.array(x) for x in longer]

    def work(keys: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not docs.num_rows:
            return schema.empty_table()
        tokens = Tokens(docs.column("text").combine_chunks(), 2 + len(higher))
        counts = Counts(tokens, told)
        both = tuple([m + f for m, f in zip(*x)] for x in zip(counts.main, counts.fold))
        word = both[0][WORD]
        base = np.log10((word + 0.1) / (tokens_n + 0.1 * (distinct + 1)))
        p = interpolated(both, tokens_n, distinct, w, higher)
        at = np.cumsum(tokens.count) - tokens.count
        total = lambda x: np.add.reduceat(x, at)
        ids = docs.column("doc_id")
        held = folds(ids) == HELD_OUT
        return pa.Table.from_arrays([ids.combine_chunks(), pa.array(held), pa.array(tokens.count.astype(np.int64)), pa.array(total((word > 0).astype(np.int64))), pa.array(np.full(len(at), tokens_n, np.int64)), pa.array(total(base)), pa.array(total(np.log10(p)))], schema=schema)

    return work


def lm_scores(docs: DataFrame, group_bytes: int = GROUP_BYTES, shard_bytes: int = SHARD_BYTES, order: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``order`` words make the longest n-gram, two at least."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = text_bytes(rows)
    groups, shards = max(4, size // group_bytes), 1 << (max(4, size // shard_bytes) - 1).bit_length()
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("bucket")
    grouped = rows.select(bucket, "doc_id", "text")
    told = []
    for kinds in ((WORD, BIGRAM), *((k,) for k in range(BIGRAM + 1, order))):
        asked = grouped.groupBy("bucket").applyInArrow(_ask(shards, kinds), ASK)
        told.append(materialise(asked.groupBy("kind", "shard").applyInArrow(_tell, TOLD), "lm-counts"))
    totals = told[0].where("bucket < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "main_tokens", "main_distinct")]).first()

    def answered(longest: int, f, schema: str) -> DataFrame:
        answers = reduce(DataFrame.unionByName, told[: longest - 1]).where("bucket >= 0").select("bucket", "kind", "shard", "n", "main", "fold")
        return grouped.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(f, schema)

    # the statistics have one row per bucket and pair of levels at most, whatever the input's size
    def counted(longest: int, f) -> tuple[np.ndarray, np.ndarray]:
        with shuffle_files_dropped(spark):
            cells = answered(longest, f, "cell BIGINT, n BIGINT").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        return cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)

    n_main, main_distinct, longer = totals["main_tokens"], totals["main_distinct"], []
    weights = learn(*counted(2, _statistics(n_main)), main_distinct)
    for k in range(3, order + 1):
        longer.append(learn_longer(*counted(k, _statistics(n_main, main_distinct, weights, tuple(longer)))))
    schema = "doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE"
    return answered(order, _score(int(totals["tokens"]), int(totals["distinct"]), weights.tolist(), [x.tolist() for x in longer]), schema)


def op7_lm_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), order=ORDER)
