"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. Texts with the same set of word shingles are one item with a number of its own (the row with the
   smallest id stands for it), so copies never meet each other.
2. Each item has ``trees`` labels of ``longest`` MinHash values. The labels of a tree are sorted, so
   that its prefix trie is read off the common prefixes of neighbours, and every item climbs from its
   leaf: always as far as the depth k at which 1 - (1 - t^k)^trees, the chance that two items at the
   threshold t share a prefix in some tree, reaches the target recall; then on to ``shortest`` while
   the node holds ``room`` items at most. Items meet below the node where their climb ends, so pairs
   with few others around them meet by shorter prefixes than those in crowded nodes.
3. Items that meet, directly or through others, form a cell (connected components over star edges
   from each node's smallest item). A cell holds every candidate pair of its items.
4. Each cell is verified exactly, in square blocks of about ``block`` items: all pairs' common
   shingles are counted by matrix products, so pairs are never rows. Items of a cell that needs
   several blocks are dealt to them by size class first (sizes within a factor of the threshold), and
   blocks meet only those of their own and the next class, as others cannot link. A block returns each
   item's links and a spanning forest of its linked pairs, and components of those are the classes.

Shingles are five consecutive words ``[^\\x20\\x09-\\x0D]+``, unchanged, by 64-bit hash; a text of one
to four words has one shingle, all its words. Pairs link at a Jaccard similarity of 0.8 or more of
their shingle sets.

Defined cases: null and wordless texts have no shingles and link to nothing, not even each other;
rows with null ``doc_id`` are left out of the join (class null, no links); rows that repeat an id are
rows of their own: with equal shingles they are copies, with different ones each links by its own; an
empty table gives an empty result. Further columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sweepgrid.llm.components import components, contracting
from sweepgrid.llm.shared import handing_back, materialise, table, unused
from sweepgrid.llm.words import Words, mix, ngrams, slices

SHINGLE, THRESHOLD = 5, 0.8
TREES, LONGEST, RECALL = 24, 10, 0.995
#: The depth that an item may climb to, and the most items of a node that it climbs to beyond depth().
SHORTEST, ROOM = 5, 8
#: Items of one block of a cell.
BLOCK = 512
_COLUMNS = 4096
_PLACE = ("cell", "class", "place", "blocks", "before", "after")


def depth(trees: int, longest: int, threshold: float, recall: float) -> int:
    """The longest prefix, of ``longest`` at most, at which pairs at the threshold meet with the target recall."""
    k = longest
    while k > 1 and 1 - (1 - threshold**k) ** trees < recall:
        k -= 1
    return k


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in a row, how many each text has)."""
    g, left, parts = ngrams(words.hash, n), words.left(), []
    for d in range(len(words.count)):
        a, c = int(words.first[d]), int(words.count[d])
        if c >= n:
            parts.append(np.unique(g[a : a + c - n + 1]))
        elif c:
            parts.append(mix(np.add.reduce(words.hash[a : a + c] * np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, c + 1, dtype=np.uint64), keepdims=True)))
        else:
            parts.append(np.zeros(0, np.uint64))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


def permutations(trees: int, longest: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The (a, b) of ``longest`` permutations of every tree."""
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 31, trees * longest, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, trees * longest, dtype=np.uint32)


def signature(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of one set: the least of a x + b (mod 2**32) over its members, for each (a, b)."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):
        np.minimum(out, (x[k : k + 256, None] * a + b).min(0), out=out)
    return out


def roots(labels: np.ndarray, shortest: int) -> np.ndarray:
    """Per item and tree (labels are item, tree, value): the key of the node at depth ``shortest``."""
    acc = np.broadcast_to(np.arange(1, labels.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), labels.shape[:2])
    for j in range(shortest):
        acc = mix(acc + labels[:, :, j])
    return acc


def meet(root: np.ndarray, label: np.ndarray, ids: np.ndarray, size: np.ndarray, least: int, shortest: int, room: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges between items that meet, from rows sorted by root and label (the values after the root's).

    Every row climbs from its leaf to depth ``least``, and on to ``shortest`` while the node holds
    ``room`` rows at most. Nodes at ``least`` are stars around their smallest id; in smaller ones
    beyond it, each pair meets whose sizes allow the threshold.
    """
    n, longest = len(root), shortest + label.shape[1]
    if n < 2:
        return ids[:0], ids[:0]
    # values in common with the row before
    shared = np.zeros(n, np.int64)
    same = root[1:] == root[:-1]
    shared[1:] = np.where(same, shortest + np.logical_and.accumulate(label[1:] == label[:-1], 1).sum(1), 0)
    reach = np.full(n, longest)
    for d in range(longest - 1, shortest - 1, -1):
        node = np.cumsum(shared < d)
        held = np.bincount(node)[node]
        reach = np.where((d >= least) | (held <= room), d, reach)
    new = shared < reach
    node, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    first = np.minimum.reduceat(ids, starts)[node]
    star = (reach >= least) & (ids != first)
    a, b = [ids[star]], [first[star]]
    small = reach < least
    for o in range(1, min(room, n)):
        x, y = size[:-o], size[o:]
        pick = small[:-o] & (node[:-o] == node[o:]) & (np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9) & (ids[:-o] != ids[o:])
        a.append(ids[:-o][pick])
        b.append(ids[o:][pick])
    return np.concatenate(a), np.concatenate(b)


def set_keys(flat: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """128 bits, in two halves, that identify each set of shingles."""
    ends = np.cumsum(size)
    sums = (np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ np.uint64(seed)), dtype=np.uint64)]) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344))
    return [mix(x[ends] - x[ends - size]).view(np.int64) for x in sums]


def _items(n: int, trees: int, longest: int):
    """Per row: its set's key and size, and its label in each tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(trees, longest)
        for batch in slices(batches):
            flat, size = shingles(Words(batch.column("text")), n)
            labels = [signature(flat[e - s : e], a, b).tobytes() if s else b"" for e, s in zip(np.cumsum(size).tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *(pa.array(x) for x in set_keys(flat, size)), pa.array(size), pa.array(labels, pa.binary())], names=["doc_id", "mark", "set_a", "set_b", "n", "labels"])

    return work


def _fixed(raw: np.ndarray, rows: int) -> pa.Array:
    """Binary values of equal length, from their bytes in a row."""
    width = raw.nbytes // max(rows, 1)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _leaves(trees: int, longest: int, shortest: int):
    """One row per item and tree: the root, and the values after it, most significant byte first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.frombuffer(b"".join(batch.column("labels").to_pylist()), np.uint32).reshape(-1, trees, longest)
            rows = pa.array(np.repeat(np.arange(len(labels)), trees))
            rest = np.ascontiguousarray(labels[:, :, shortest:]).astype(">u4")
            yield pa.RecordBatch.from_arrays([pa.array(roots(labels, shortest).reshape(-1).view(np.int64)), _fixed(rest, len(labels) * trees), batch.column("rep_id").take(rows), batch.column("n").take(rows)], names=["root", "label", "id", "n"])

    return work


def _climb(least: int, longest: int, shortest: int, room: int, threshold: float):
    """Edges of items that meet, from rows sorted by root and label; a root's rows come one after the other."""

    def edges(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        label = np.frombuffer(b"".join(t.column("label").to_pylist()), ">u4").reshape(t.num_rows, longest - shortest)
        a, b = meet(t.column("root").to_numpy(), label, t.column("id").to_numpy(), t.column("n").to_numpy(), least, shortest, room, threshold)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            root = batch.column("root").to_numpy()
            if held and held[-1].column("root")[-1].as_py() != root[0]:
                yield edges(held)
                held = []
            other = np.flatnonzero(root != root[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield edges([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield edges(held)

    return work


def _sets(n: int):
    """The shingles of each row whose set is that of the item it is joined with."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, size = shingles(Words(batch.column("text")), n)
            ends = np.concatenate([[0], np.cumsum(size)]) * 8
            sets = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            carried = ("id", "copies", *_PLACE)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), sets], names=[*carried, "shingles"])
            keys = set_keys(flat, size)
            yield out.filter(pa.array((keys[0] == batch.column("set_a").to_numpy()) & (keys[1] == batch.column("set_b").to_numpy())))

    return work


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common members of each pair of sets, counted by products of 0/1 matrices over shared members."""
    a, b = np.concatenate(left), np.concatenate(right)
    rows_a, rows_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if len(shared):
        at_a, at_b = (np.minimum(np.searchsorted(shared, x), len(shared) - 1) for x in (a, b))
        in_a, in_b = shared[at_a] == a, shared[at_b] == b
        for k in range(0, len(shared), _COLUMNS):
            width = min(_COLUMNS, len(shared) - k)
            pick_a, pick_b = in_a & (at_a >= k) & (at_a < k + width), in_b & (at_b >= k) & (at_b < k + width)
            m, w = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            m[rows_a[pick_a], at_a[pick_a] - k] = 1
            w[rows_b[pick_b], at_b[pick_b] - k] = 1
            out += m @ w.T
    return out


_LINKS = pa.schema([("id", pa.int64()), ("to", pa.int64()), ("links", pa.int64()), ("linked_rows", pa.int64())])


def _verify(threshold: float):
    def work(keys: tuple, t: pa.Table) -> pa.Table:
        step, x, y = (k.as_py() for k in keys[2:])
        same = step == 0 and x == y
        # rows that repeat an id with equal shingles are one item
        t = t.take(pa.array(np.unique(t.column("id").to_numpy(), return_index=True)[1]))
        ids, side, copies = (t.column(c).to_numpy() for c in ("id", "side", "copies"))
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == int(not same))
        size = np.array([len(s) for s in sets], np.float64)
        shared = common([sets[i] for i in rows], [sets[i] for i in columns]).astype(np.float64)
        linked = shared >= threshold * (size[rows][:, None] + size[columns][None, :] - shared) - 1e-9
        if same:
            np.fill_diagonal(linked, False)
        links, linked_rows = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        links[rows] += linked.sum(1)
        linked_rows[rows] += linked @ copies[columns]
        if not same:
            links[columns] += linked.sum(0)
            linked_rows[columns] += linked.T @ copies[rows]
        # the smallest item of each linked group in this block
        label = np.arange(len(ids))  # ids are sorted
        while True:
            best = label.copy()
            up = np.where(linked, label[columns][None, :], len(ids)).min(1, initial=len(ids))
            down = np.where(linked, label[rows][:, None], len(ids)).min(0, initial=len(ids))
            best[rows] = np.minimum(best[rows], up)
            best[columns] = np.minimum(best[columns], down)
            best = np.minimum(best, best[best])
            if (best == label).all():
                break
            label = best
        to, keep = ids[label], links > 0
        return pa.Table.from_arrays([pa.array(v[keep]) for v in (ids, to, links, linked_rows)], schema=_LINKS)

    return work


def near_join(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL, block: int = BLOCK, shortest: int = SHORTEST, room: int = ROOM) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_linked_rows, n_copies, rep_id, n_shingles.

    ``rep_id`` is the row that stands for all with the same shingles, of which there are
    ``n_copies``; ``n_links`` counts the other shingle sets at the threshold or above,
    ``n_linked_rows`` all other rows; ``class_id`` is the smallest id that links lead to.
    """
    return _joined(docs, n, threshold, trees, longest, recall, block, shortest, room).drop("group", "mark")


def _joined(docs: DataFrame, n: int, threshold: float, trees: int, longest: int, recall: float, block: int, shortest: int, room: int) -> DataFrame:
    """As near_join, with a number of its own for each class (``group``, null without words) and a hash of each text (``mark``)."""
    k = depth(trees, longest, threshold, recall)
    shortest = min(shortest, k)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    keyed = materialise(marked.mapInArrow(handing_back(_items(n, trees, longest)), "doc_id BIGINT, mark BIGINT, set_a BIGINT, set_b BIGINT, n BIGINT, labels BINARY"), "items")
    full = keyed.where("n > 0 AND doc_id IS NOT NULL")
    sets = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_copies"), F.min("n").alias("n"), F.min("labels").alias("labels"))
    # the numbers are fixed by writing them
    of = materialise(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    leaves = of.select(F.col("id").alias("rep_id"), "n", "labels").mapInArrow(handing_back(_leaves(trees, longest, shortest)), "root BIGINT, label BINARY, id BIGINT, n BIGINT")
    met = leaves.repartition("root").sortWithinPartitions("root", "label").mapInArrow(handing_back(contracting(_climb(k, longest, shortest, room, threshold))), "a BIGINT, b BIGINT")
    cells = components(met, contract=False).withColumnRenamed("label", "cell").join(of.select("id", "rep_id", "set_a", "set_b", "n", F.col("n_copies").alias("copies")), "id")
    # written, so that the plan that verifies stays small: the driver keeps every state of a plan
    placed = materialise(_places(cells, threshold, block), "placed")
    # by sort-merge at any size: what is placed grows with the input
    active = rows.where("doc_id IS NOT NULL").join(placed.withColumnRenamed("rep_id", "doc_id").hint("merge"), "doc_id")
    members = active.select("id", "text", "set_a", "set_b", "copies", *_PLACE).mapInArrow(handing_back(_sets(n)), "id BIGINT, copies BIGINT, cell BIGINT, class INT, place INT, blocks INT, before INT, after INT, shingles BINARY")
    verified = materialise(_pairs(members).groupBy("cell", "low", "step", "x", "y").applyInArrow(_verify(threshold), "id BIGINT, to BIGINT, links BIGINT, linked_rows BIGINT"), "links")
    counts = verified.groupBy("id").agg(F.sum("links").alias("links"), F.sum("linked_rows").alias("linked_rows"))
    linked = components(verified.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))).join(of.select("id", "rep_id"), "id")
    # a class is named by the smallest document of its items
    classes = linked.join(linked.groupBy("label").agg(F.min("rep_id").alias("class")), "label").select("id", "label", "class")
    joined = keyed.drop("labels").join(of.drop("labels", "n"), ["set_a", "set_b"], "left").join(counts, "id", "left").join(classes, "id", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("rep_id"), F.col("doc_id")))
    known = F.col("doc_id").isNotNull() & F.col("rep_id").isNotNull()
    count = lambda c, other: F.when(known, F.coalesce(F.col(c), F.lit(other))).otherwise(F.lit(other))
    return joined.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("class"), mine)).alias("class_id"),
        count("links", 0).alias("n_links"),
        (count("linked_rows", 0) + count("n_copies", 1) - 1).alias("n_linked_rows"),
        count("n_copies", 1).alias("n_copies"),
        mine.alias("rep_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("label", "id").alias("group"),
        "mark",
    )


def _places(cells: DataFrame, threshold: float, block: int) -> DataFrame:
    """Adds each item's size class, its place among the blocks of the class, and how many blocks its
    own class, the one before and the one after have. Cells of one block have one class."""
    # a little wider than the threshold, so that rounding never sets linked sizes two classes apart
    by_size = F.floor(F.log("n") / F.lit(-1.000001 * math.log(threshold))).cast("int") if threshold < 1 else F.col("n").cast("int")
    cells = cells.withColumn("size", by_size)
    # a row per cell and size class, of which a cell has few
    whole, order = Window.partitionBy("cell"), Window.partitionBy("cell").orderBy("size")
    held = cells.groupBy("cell", "size").agg(F.count(F.lit(1)).alias("held")).withColumn("items", F.sum("held").over(whole))
    several = F.col("items") > block
    held = held.withColumn("class", F.when(several, F.col("size")).otherwise(0)).withColumn("blocks", F.when(several, F.ceil(F.col("held") / block)).otherwise(1).cast("int"))
    for name, other, step in (("before", F.lag, -1), ("after", F.lead, 1)):
        next_to = several & (other("size").over(order) == F.col("size") + step)
        held = held.withColumn(name, F.when(next_to, other("blocks").over(order)).otherwise(0))
    out = cells.join(held, ["cell", "size"]).withColumn("place", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return out.select("id", "rep_id", "set_a", "set_b", "copies", *_PLACE)


def _pairs(members: DataFrame) -> DataFrame:
    """The items of every unordered pair of blocks that can hold links, a block with itself included.

    A pair is (low, step, x, y): block x of size class ``low`` and block y of class ``low + step``;
    ``side`` tells which of the two an item belongs to.
    """
    place, size = F.col("place"), F.col("class")
    zero, one = F.lit(0), F.lit(1)
    pair = lambda low, step, x, y, side: F.struct(low.alias("low"), step.alias("step"), x.alias("x"), y.alias("y"), side.alias("side"))
    upto = lambda count: F.filter(F.sequence(zero, F.greatest(F.col(count), one) - 1), lambda o: o < F.col(count))
    own = F.transform(upto("blocks"), lambda o: pair(size, zero, F.least(place, o), F.greatest(place, o), (o < place).cast("int")))
    after = F.transform(upto("after"), lambda o: pair(size, one, place, o, zero))
    before = F.transform(upto("before"), lambda o: pair(size - 1, one, o, place, one))
    return members.withColumn("pair", F.explode(F.concat(own, after, before))).select("id", "cell", "pair.*", "copies", "shingles")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: that with the smallest ``doc_id``, by a hash of
    the text where classes hold several texts of that id.

    Rows without words or without an id have no class and stay; rows that repeat both id and text are
    one document and stay or go together.
    """
    names = docs.columns
    of, mark = unused(names, "kept_of", "kept_mark")
    all_ = _joined(docs, SHINGLE, THRESHOLD, TREES, LONGEST, RECALL, BLOCK, SHORTEST, ROOM).where("doc_id IS NOT NULL")
    first = all_.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("best")).select("best.*")
    # wordless texts in full: each is a document of its own
    kept = first.unionByName(all_.where("group IS NULL").select("doc_id", "mark").distinct()).toDF(of, mark)
    hashed = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = docs.join(kept.hint("merge"), (F.col("doc_id").cast("bigint") == F.col(of)) & (hashed == F.col(mark)), "left_semi")
    return same.unionByName(docs.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in names])


def op10_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(table(spark, sf_dir, "documents"))
