"""Toxicity by weak supervision.

1. Voters. Terms (whole words, and stems that many words begin with) are mined from a bounded
   number of labelled training rows (``LABELLED``, the first by a hash of the id; near copies count
   as one) and stand beside a fixed short lexicon and pattern voters. Every significant term votes; of
   a stem and a word that occur in the same rows, only the stem does.
2. Label model. A generative model with a latent class is fitted to the votes by
   expectation-maximisation. Voters that stay correlated within a
   class depend on one another: in each class the votes follow a forest, the maximum spanning one by
   conditional mutual information, with a table of its own on every edge. The given label is one more
   voter, whose accuracy is estimated like the others'.
3. Classifier. A linear model over the voters, their number and strength, and the pattern features
   is trained on the posterior labels and scores every document.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never read. Labels,
language, source and ids are never inputs of a score.

Defined cases: a null text is empty and gets the score of a document without any hit; a null
``doc_id`` counts as the text "" (not held out, no label); repeated ids are rows of their own;
without labelled rows of both classes the lexicon and patterns alone vote, with fixed accuracies;
an empty table gives an empty result. Further columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.llm.shared import handing_back, materialise, table, unused
from sweepgrid.llm.words import Words, ngrams, slices

HELD_OUT = 2
THRESHOLD = 0.3
#: Labelled rows used for learning at most.
LABELLED = 24_000
#: A general lexicon; everything else is mined.
LEXICON = ("bastard", "clown", "crap", "disgusting", "dumb", "filth", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "shut up", "stupid", "trash", "vermin", "worthless")
STEMS = (4, 5, 6, 7)
#: Likelihood ratio (twice its logarithm) of a mined term; chance reaches it about once in 10**7 terms.
SIGNIFICANT = 30.0
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<![^\W_])(?=[^\W\d_]*[0-9@$*!])[a-z@$*!0-9]*[a-z][0-9@$*!]+[a-z][a-z@$*!0-9]*(?![^\W_])")
_LEET = str.maketrans("013457@$!", "oleastasi")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b")
PATTERNS = ("two_terms", "dense_terms", "masked_term", "shouting", "insult_frame")
_FRAME = re.compile(r"\b(?:you|u|they|he|she)(?:'re|'s| are| is)? (?:a |an |all |such |so |just )*$")


class Terms:
    """Counts of each term at the beginnings of words; a term ending in ``*`` is a stem."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.automaton = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[int, bool]]] = {}
        for k, term in enumerate(terms):
            by_text.setdefault(term.rstrip("*"), []).append((k, term.endswith("*")))
        for text, which in by_text.items():
            self.automaton.add_word(text, (len(text), which))
        if by_text:
            self.automaton.make_automaton()

    def hits(self, lower: str) -> list[tuple[int, int]]:
        """(term, position) of each hit."""
        out = []
        if not len(self.automaton):
            return out
        size = len(lower)
        for end, (length, which) in self.automaton.iter(lower):
            begin = end - length + 1
            if begin and lower[begin - 1].isalpha():
                continue
            whole = end + 1 >= size or not lower[end + 1].isalpha()
            out += [(k, begin) for k, stem in which if stem or whole]
        return out


def described(text: str, terms: Terms) -> tuple[Counter, list[float]]:
    """(hits by term, pattern values) of one text."""
    lower = text.lower()
    hits = terms.hits(lower)
    count = Counter(k for k, _ in hits)
    places = len({b for _, b in hits})
    words = max(1, text.count(" ") + text.count("\n") + 1)
    masked = 0
    if "*" in lower or "@" in lower or "$" in lower or "!" in lower or re.search("[0-9]", lower):
        masked = sum(bool(terms.hits(m.group().translate(_LEET))) for m in _MASKED.finditer(lower))
    shout = sum(1 for _ in _SHOUT.finditer(text))
    framed = sum(bool(_FRAME.search(lower[max(0, b - 40) : b])) for _, b in hits)
    return count, [float(places), 1000.0 * places / (words + 50), float(masked), 1000.0 * shout / (words + 50), float(framed)]


def pattern_votes(p: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters, in the order of PATTERNS."""
    return np.stack([p[:, 0] >= 2, p[:, 1] >= 1.5, p[:, 2] >= 1, p[:, 3] >= 20, p[:, 4] >= 1], 1)


class Votes:
    """Who votes in which row, by the voters of each row: (row, voter) entries in order of both, no dense matrix."""

    def __init__(self, lists: list[np.ndarray], m: int):
        self.n, self.m = len(lists), m
        self.count = np.array([len(x) for x in lists], np.int64)
        self.row = np.repeat(np.arange(self.n), self.count)
        self.voter = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)

    @classmethod
    def of(cls, dense: np.ndarray) -> Votes:
        return cls([np.flatnonzero(x) for x in dense], dense.shape[1])

    def by_row(self, weight: np.ndarray) -> np.ndarray:
        """The sum of the voters' weights in each row."""
        return np.bincount(self.row, weight[self.voter], self.n)

    def by_voter(self, weight: np.ndarray) -> np.ndarray:
        """The sum of the rows' weights for each voter."""
        return np.bincount(self.voter, weight[self.row], self.m)

    def beside(self, parent: np.ndarray) -> np.ndarray:
        """Entries whose voter's parent votes in the same row; a parent of -1 is none."""
        keys, at = self.row * self.m + self.voter, np.flatnonzero(parent[self.voter] >= 0)
        wanted = self.row[at] * self.m + parent[self.voter[at]]
        place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at[keys[place] == wanted]

    def pairs(self, weights: tuple[np.ndarray, ...], block: int = 128, at_once: int = 32_768) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first, pairs) for each block of voters: rows of the block's voters, columns of all from ``first``
        on, one matrix for each weighting of the rows. Never more than a block is held."""
        order = np.argsort(self.voter, kind="stable")
        row, voter = self.row[order], self.voter[order]
        first = np.searchsorted(voter, np.arange(self.m + 1))
        for begin in range(0, self.m, block):
            end = min(begin + block, self.m)
            own = slice(first[begin], first[end])
            dense = np.zeros((self.n, end - begin), np.float32)
            dense[row[own], voter[own] - begin] = 1
            out = [np.zeros((end - begin, self.m - begin)) for _ in weights]
            for a in range(first[begin], len(row), at_once):
                part = slice(a, min(a + at_once, len(row)))
                starts = np.flatnonzero(np.append(True, np.diff(voter[part]) > 0))
                seen, who = dense[row[part]], voter[part][starts] - begin
                for total, w in zip(out, weights):
                    total[:, who] += np.add.reduceat(seen * w[row[part], None], starts, axis=0).T
            yield begin, out


def spanning(edges: list[tuple[int, int, float, float]]) -> list[tuple[int, int, float, float]]:
    """The maximum spanning forest of edges (a, b, information, correlation); ties by a, then b."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for e in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        x, y = find(e[0]), find(e[1])
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(e)
    return kept


class LabelModel:
    """Binary voters of a latent class: in each class, a forest of dependences between them.

    ``hit`` and ``false`` are how often each votes in the two classes; ``edges`` are (voter, voter it
    depends on); ``correlation`` tells how votes at the ends of an edge are correlated within the
    classes; ``posterior`` is each row's probability of class 1. ``gold`` is 1, 0 or -1 (not known).

    Pairs of voters are counted by blocks of voters, and only a spanning forest is kept of each block, so
    memory grows with the votes and with the voters, not with the voters' square.
    """

    def __init__(self, votes: Votes | np.ndarray, gold: np.ndarray, rounds: int = 25, prior: float = 1.0, tied: float = 0.2):
        votes = votes if isinstance(votes, Votes) else Votes.of(votes)
        # rows of equal votes are worked on once
        ends = np.cumsum(votes.count)
        rows = [votes.voter[e - k : e] for e, k in zip(ends.tolist(), votes.count.tolist())]
        place, at = np.zeros(votes.n, np.int64), {}
        for i, (voters, g) in enumerate(zip(rows, gold.tolist())):
            place[i] = at.setdefault((voters.tobytes(), g), len(at))
        _, chosen, times = np.unique(place, return_index=True, return_counts=True)
        v, gold, n = Votes([rows[i] for i in chosen.tolist()], votes.m), gold[chosen], times.astype(float)
        given, known = (gold == 1) * n, (gold >= 0) * n
        self.prior, self.total, self.m, self.all = prior, n.sum(), v.m, v.by_voter(n)
        self.edges: list[tuple[int, int]] = []
        # before anything is counted, the given label is believed, and votes where there is none
        q = np.where(gold >= 0, np.where(gold == 1, 0.9, 0.02), np.clip(0.02 + 0.45 * v.count, 0.02, 0.95))
        for k in range(rounds):
            w = q * n
            self.count(v, w)
            if k % 5 == 0:
                self.edges = self.forest(v, w, n, tied)
                both = v.beside(self.parent)
                self.all_both = np.bincount(v.voter[both], n[v.row[both]], v.m)
            up = np.bincount(v.voter[both], w[v.row[both]], v.m)
            self.both = [up, np.maximum(self.all_both - up, 0.0)]
            self.share = float(np.clip(w.sum() / self.total, 1e-4, 1 - 1e-4))
            right = (q * given).sum(), ((1 - q) * given).sum()
            self.gold = np.clip((right[0] + prior) / ((q * known).sum() + 2 * prior), 1e-3, 1 - 1e-3), np.clip((right[1] + 0.1 * prior) / (((1 - q) * known).sum() + 2 * prior), 1e-5, 1 - 1e-3)
            z = np.log(self.share / (1 - self.share)) + self.evidence(v)
            z = z + (gold >= 0) * np.where(gold == 1, np.log(self.gold[0] / self.gold[1]), np.log((1 - self.gold[0]) / (1 - self.gold[1])))
            before, q = q, 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            if k % 5 and np.abs(q - before).max() < 1e-4:
                break
        self.posterior = q[place]

    def count(self, v: Votes, w: np.ndarray) -> None:
        """Rows and votes in each class; ``w`` is the weight of each row in class 1."""
        self.size = w.sum(), self.total - w.sum()
        up = v.by_voter(w)
        self.votes = [up, np.maximum(self.all - up, 0.0)]
        self.hit = np.clip((up + self.prior) / (self.size[0] + 2 * self.prior), 1e-4, 1 - 1e-4)
        self.false = np.clip((self.votes[1] + 0.1 * self.prior) / (self.size[1] + 2 * self.prior), 1e-6, 1 - 1e-4)

    def tables(self, i: np.ndarray, j: np.ndarray, strength: float = 4.0) -> list[np.ndarray]:
        """For each class, P(voter i votes | voter j, its parent, does not, does), drawn towards how often i votes at all."""
        out = []
        for size, votes, pairs, alone in zip(self.size, self.votes, self.both, (self.hit, self.false)):
            with_j, both, all_i = votes[j], pairs[i], votes[i]
            given = [((all_i - both), size - with_j), (both, with_j)]
            out.append(np.stack([np.clip((n + strength * alone[i]) / (np.maximum(d, 0) + strength), 1e-6, 1 - 1e-6) for n, d in given]))
        return out

    def forest(self, v: Votes, w: np.ndarray, n: np.ndarray, tied: float) -> list[tuple[int, int]]:
        """The maximum spanning forest, by conditional mutual information, of voters whose votes are correlated within the classes."""
        p = [np.clip(x / max(size, 1e-9), 1e-9, 1 - 1e-9) for size, x in zip(self.size, self.votes)]
        spread = sum(size * x * (1 - x) for size, x in zip(self.size, p))
        kept: list[tuple[int, int, float, float]] = []
        for begin, (up, every) in v.pairs((w, n)):
            rows, columns = slice(begin, begin + len(up)), slice(begin, self.m)
            both = [x / max(size, 1e-9) for size, x in zip(self.size, (up, np.maximum(every - up, 0.0)))]
            rest = sum(size * (x - np.outer(y[rows], y[columns])) for size, x, y in zip(self.size, both, p))
            correlation = rest / np.sqrt(np.outer(spread[rows], spread[columns]))
            a, b = np.nonzero(np.triu(np.abs(correlation) > tied, 1))
            told = np.zeros(len(a))
            for size, x, y in zip(self.size, both, p):
                x, s, t = x[a, b], y[rows][a], y[columns][b]
                for joint, f, g in ((x, s, t), (s - x, s, 1 - t), (t - x, 1 - s, t), (1 - s - t + x, 1 - s, 1 - t)):
                    joint = np.maximum(joint, 1e-12)
                    told += size * joint * np.log(joint / (f * g))
            kept = spanning(kept + list(zip((a + begin).tolist(), (b + begin).tolist(), told.tolist(), correlation[a, b].tolist())))
        self.correlation = {e: c for x, y, _, c in kept for e in ((x, y), (y, x))}
        linked: dict[int, list[int]] = {}
        for x, y, _, _ in kept:
            linked.setdefault(x, []).append(y)
            linked.setdefault(y, []).append(x)
        edges, self.parent = [], np.full(self.m, -1)
        seen: set[int] = set()
        for start in sorted(linked):
            stack = [] if start in seen else [start]
            seen.add(start)
            while stack:
                x = stack.pop()
                for y in linked[x]:
                    if y not in seen:
                        seen.add(y)
                        edges.append((y, x))
                        self.parent[y] = x
                        stack.append(y)
        return edges

    def evidence(self, v: Votes | np.ndarray) -> np.ndarray:
        """The votes' log likelihood ratio of the two classes, per row."""
        v = v if isinstance(v, Votes) else Votes.of(v)
        lone, off = np.log(self.hit / self.false), np.log((1 - self.hit) / (1 - self.false))
        linear, constant = lone - off, off.sum()
        if not self.edges:
            return constant + v.by_row(linear)
        i, j = np.array(self.edges).T
        up, down = self.tables(i, j)
        # log ratios of the four cases of (voter j, voter i)
        r = np.stack([np.log((1 - up) / (1 - down)), np.log(up / down)], 1)
        constant += (r[0, 0] - off[i]).sum()
        linear[i] += r[0, 1] - r[0, 0] - (lone - off)[i]
        np.add.at(linear, j, r[1, 0] - r[0, 0])
        together = np.zeros(self.m)
        together[i] = r[1, 1] - r[1, 0] - r[0, 1] + r[0, 0]
        both = v.beside(self.parent)
        return constant + v.by_row(linear) + np.bincount(v.row[both], together[v.voter[both]], v.n)


class Inputs:
    """Inputs of the classifier: for each row its voting terms, and some numbers beside them."""

    def __init__(self, votes: Votes, more: np.ndarray):
        self.votes, self.more = votes, more

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.votes.by_row(w[: self.votes.m]) + self.more @ w[self.votes.m :]

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([self.votes.by_voter(r), self.more.T @ r])

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        share = self.votes.by_voter(np.ones(self.votes.n)) / max(self.votes.n, 1)
        return np.concatenate([share, self.more.mean(0)]), np.concatenate([np.sqrt(share * (1 - share)), self.more.std(0)])

    def squares(self, d: np.ndarray) -> np.ndarray:
        return np.concatenate([self.votes.by_voter(d), (self.more * self.more).T @ d])


class Linear:
    """Logistic regression on standardised inputs by Newton's method, whose steps are solved by conjugate
    gradients: only products with the inputs are taken, and no matrix of their pairs is held."""

    def __init__(self, x: Inputs, y: np.ndarray, ridge: float = 2.0, rounds: int = 25):
        mean, scale = x.moments()
        scale = scale + 1e-3
        size = len(scale)
        penalty = np.append(np.full(size, ridge), 1e-6)

        def times(w: np.ndarray) -> np.ndarray:
            v = w[:-1] / scale
            return x.times(v) + (w[-1] - v @ mean)

        def transposed(r: np.ndarray) -> np.ndarray:
            total = r.sum()
            return np.append((x.transposed(r) - mean * total) / scale, total)

        w = np.zeros(size + 1)
        w[-1] = np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
            d = p * (1 - p) + 1e-6
            curved = np.append((x.squares(d) - 2 * mean * x.transposed(d) + mean * mean * d.sum()) / (scale * scale), d.sum()) + penalty
            step = conjugate(lambda s: transposed(d * times(s)) + penalty * s, transposed(y - p) - penalty * w, np.maximum(curved, 1e-9))
            w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-4:
                break
        self.w, self.b = w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())

    def score(self, x: Inputs) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.times(self.w) + self.b, -30, 30)))


def conjugate(times: Callable[[np.ndarray], np.ndarray], wanted: np.ndarray, diagonal: np.ndarray, within: float = 1e-10, rounds: int = 2000) -> np.ndarray:
    """Solves a positive definite system by conjugate gradients, preconditioned by its diagonal."""
    s, r = np.zeros_like(wanted), wanted.copy()
    z = r / diagonal
    p, rz = z.copy(), r @ z
    least = within * within * rz
    for _ in range(rounds):
        if rz <= least or rz == 0:
            break
        hp = times(p)
        a = rz / (p @ hp)
        s, r = s + a * p, r - a * hp
        z = r / diagonal
        before, rz = rz, r @ z
        p = z + rz / before * p
    return s


def inputs(hits: list[Counter], patterns: np.ndarray, strength: np.ndarray) -> Inputs:
    """Inputs of the classifier: per document one for each voting term, the sum and the largest of its
    terms' log odds, the number of different terms and of hits, and the pattern values on a logarithmic scale."""
    voters, more = [], np.zeros((len(hits), 4 + patterns.shape[1]))
    for i, c in enumerate(hits):
        which = np.array(sorted(c), np.int64)
        voters.append(which)
        if c:
            more[i, :4] = np.clip(strength[which].sum(), -50, 50), np.clip(strength[which].max(), -50, 50), np.log1p(len(c)), np.log1p(sum(c.values()))
    more[:, 4:] = np.log1p(patterns)
    return Inputs(Votes(voters, len(strength)), more)


class Model:
    """Terms with their log odds under the label model, and the linear classifier."""

    def __init__(self, terms: list[str], strength: np.ndarray, linear: Linear):
        self.terms, self.strength, self.linear = terms, strength, linear

    def scorer(self):
        terms = Terms(self.terms)

        def score(texts: list[str], at_once: int = 2000) -> np.ndarray:
            out = [np.zeros(0)]
            for k in range(0, len(texts), at_once):
                found = [described(t, terms) for t in texts[k : k + at_once]]
                out.append(self.linear.score(inputs([c for c, _ in found], np.array([p for _, p in found]), self.strength)))
            return np.concatenate(out)

        return score


def fold(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def word_set(text: str) -> set[str]:
    """The words of a text and their stems, as terms."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) >= k}


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of the five-word shingles of each text (of its words, where there are fewer), which near copies mostly share."""
    for batch in slices(batches):
        words = Words(batch.column("text"))
        g, marks = ngrams(words.hash, 5), []
        for a, n in zip(words.first[:-1].tolist(), words.count.tolist()):
            least = g[a : a + n - 4].min() if n >= 5 else words.hash[a : a + n].sum(dtype=np.uint64)
            marks.append(int(least.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(marks, pa.int64())], names=["text", "toxic", "mark"])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            count[int(toxic)].update(word_set(text or ""))
    for toxic, found in count.items():
        items = list(found.items())
        for k in range(0, len(items), 20_000):
            part = items[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part]), pa.array(np.full(len(part), toxic, np.int32)), pa.array([n for _, n in part], pa.int64())], names=["term", "toxic", "n"])


def mined(labelled: DataFrame, positives: int, negatives: int) -> list[str]:
    """Terms far more frequent in toxic rows, the most significant first. Only these leave Spark."""
    counted = labelled.select("text", "toxic").mapInArrow(handing_back(_document_frequencies), "term STRING, toxic INT, n BIGINT")
    up, down = F.col("up").cast("double"), F.col("down").cast("double")
    both, share = up + down, positives / (positives + negatives)
    counted = counted.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("up"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("down"))
    odds = F.log((up + 0.5) / (positives + 1)) - F.log((down + 0.5) / (negatives + 1))
    # likelihood ratio of the term's own share of toxic rows against the share of all rows
    ratio = 2 * (up * F.log(up / (both * share)) + F.when(down > 0, down * F.log(down / (both * (1 - share)))).otherwise(0.0))
    good = counted.where(F.col("up") >= max(4, positives // 500)).select("term", "up", "down", ratio.alias("ratio"), odds.alias("odds")).where(f"odds > 1.5 AND ratio > {SIGNIFICANT}")
    rows = sorted(good.collect(), key=lambda r: (-r["ratio"], r["term"]))
    stems: dict[tuple, list[str]] = {}
    for r in rows:
        if r["term"].endswith("*"):
            stems.setdefault((r["up"], r["down"]), []).append(r["term"])
    shortest = lambda r: min((t for t in stems.get((r["up"], r["down"]), ()) if r["term"].startswith(t[:-1])), key=len, default=r["term"])
    return list(dict.fromkeys(shortest(r) for r in rows))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """Learn from labelled rows that are not held out, the first ``labelled`` by a hash of the id."""
    gold = labels.where(fold(F.col("doc_id")) != HELD_OUT).where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = gold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(fold(F.col("doc_id")) != HELD_OUT)
    # at most ``labelled`` ids, so this side is bounded; written, so that the documents are read once
    chosen = rows.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    # near copies tell the same once
    marked = chosen.mapInArrow(handing_back(_marked), "text STRING, toxic INT, mark BIGINT")
    sample = materialise(marked.groupBy("mark", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "labelled")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, negatives = size.get(1, 0), size.get(0, 0)
    found = mined(sample, positives, negatives) if positives >= 8 and negatives >= 8 else []
    names = list(dict.fromkeys([*LEXICON, *found]))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms(names)
        for batch in slices(batches):
            seen = [described(t or "", of) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(c) for c, _ in seen], pa.list_(pa.int32())), pa.array([[c[k] for k in sorted(c)] for c, _ in seen], pa.list_(pa.int32())), pa.array([p for _, p in seen], pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32()), batch.column("key")], names=["terms", "counts", "patterns", "toxic", "key"])

    keyed = sample.withColumn("key", F.xxhash64("text"))
    table_ = keyed.mapInArrow(handing_back(votes), "terms ARRAY<INT>, counts ARRAY<INT>, patterns ARRAY<DOUBLE>, toxic INT, key BIGINT").toPandas() if positives and negatives else None
    if table_ is None:
        strength = np.full(len(names), 3.0)
        linear = Linear(inputs([Counter(), Counter()], np.zeros((2, len(PATTERNS))), strength), np.array([0.0, 0.0]))
        linear.w, linear.b = np.concatenate([np.zeros(len(names)), [0.8, 0.0, 0.0, 0.0, 0.0, 0.3, 0.8, 0.0, 0.3]]), -3.5
        return Model(names, strength, linear)
    table_ = table_.sort_values(["toxic", "key"], kind="stable")  # the result must not depend on the order of rows
    hits = [Counter(dict(zip(t, c))) for t, c in zip(table_["terms"], table_["counts"])]
    patterns, gold_ = np.stack(table_["patterns"].to_list()), table_["toxic"].to_numpy(int)
    used = np.zeros(len(names), bool)
    for c in hits:
        used[list(c)] = True
    m, number, by_pattern = int(used.sum()), np.cumsum(used) - 1, pattern_votes(patterns)
    model = LabelModel(Votes([np.concatenate([number[sorted(c)], m + np.flatnonzero(x)]) for c, x in zip(hits, by_pattern)], m + by_pattern.shape[1]), gold_)
    strength = np.zeros(len(names))
    strength[used] = np.log(model.hit[:m] / model.false[:m]).clip(-1, 12)
    strength[~used] = 1.0
    return Model(names, strength, Linear(inputs(hits, patterns, strength), model.posterior))


def scored(docs: DataFrame, model: Model, carry: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """The carried columns of every row, and its score."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    (text,) = unused(list(carry), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(of([t or "" for t in batch.column(text).to_pylist()]))], names=[*carry, score])

    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    return rows.mapInArrow(handing_back(work), ", ".join([*(f"`{c}` {types[c]}" for c in carry), f"`{score}` DOUBLE"]))


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = scored(docs, model or train(docs, labels), ("doc_id",))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    names = tuple(docs.columns)
    (score,) = unused(list(names), "score")
    return scored(docs, train(docs, labels), names, score).where(F.col(f"`{score}`") < THRESHOLD).select(*[F.col(f"`{c}`") for c in names])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def crc_fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4
