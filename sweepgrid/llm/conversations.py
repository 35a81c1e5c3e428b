"""Cheapest repair of conversations to ``system? (user assistant)+`` or nothing, by a scan of min-plus matrices.

Edits are Keep (0), Rerole to user or assistant (1), Delete (2; the only one for blank turns and for repeats
of a role and text), Insert an empty turn (5); a truncated turn that is not deleted costs 5 more. Grammar states
are 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Each turn is a 4 x 4 matrix of
(cost, audit) elements from state to state, closed under insertions on both sides; a sequence of turns is the
product of its matrices, where elements add by cost and by concatenation of the edits' initials and the least one
counts, ties by ASCII. Two audits of the same turns and cost are never prefixes of one another (they hold as many
letters K, R and D, and a further I costs), so the order survives concatenation and the product is associative.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length spreads over partitions. Each
partition reduces what it holds of a conversation as a tree; only the first and the last conversation of a
partition can go on elsewhere, and these few matrices are reduced by eight at a time until one is left. What
came earlier anywhere in a conversation is found by an aggregation over hashes of role and text. Repaired turns
are written by a walk over sorted turns that holds one audit and one turn at a time.

Defined cases: null roles and texts are one space; turns of a conversation are in order of turn (nulls first),
ties by role, then by the text's digest; repeated rows each count; rows without ``conv_id`` are one conversation;
initials are compared as they are, so an empty or unknown role can only be reroled or deleted; an empty table
gives an empty table; further columns of any name are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.llm.shared import materialise, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_WHITE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
#: The state that each role leads to, by the state before it.
_STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Turns whose matrix is looked up, and matrices that meet in one step of the tree over partitions.
_BLOCK, _FAN = 8, 8

Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: costs add, audits are concatenated, the least of all ways counts."""
    out = []
    for row in a:
        line = []
        for j in range(4):
            ways = [(x[0] + y[0], k) for k in range(4) if (x := row[k]) and (y := b[k][j])]
            if ways:
                least = min(ways)[0]
                line.append((least, min(row[k][1] + b[k][j][1] for cost, k in ways if cost == least)))
            else:
                line.append(None)
        out.append(tuple(line))
    return tuple(out)


def _matrix(moves: list[tuple[int, int, int, str]]) -> Matrix:
    out: list[list] = [[None] * 4 for _ in range(4)]
    for i, j, cost, audit in moves:
        out[i][j] = min(out[i][j] or (cost, audit), (cost, audit))
    return tuple(map(tuple, out))


NOTHING = _matrix([(i, i, 0, "") for i in range(4)])
_ONE = _matrix([(i, i, 0, "") for i in range(4)] + [(i, j, INSERT, "I") for r in "ua" for i, j in _STEPS[r].items()])
#: Any number of insertions: more than two in a row only lead back.
INSERTIONS = times(_ONE, _ONE)


@lru_cache(maxsize=1 << 16)
def _product(turns: str) -> Matrix:
    if len(turns) > 1:
        half = len(turns) // 2
        return times(_product(turns[:half]), _product(turns[half:]))
    moves = [(i, i, DELETE, "D") for i in range(4)]
    if turns != "-":
        more = TRUNCATED if turns.isupper() else 0
        moves += [(i, j, KEEP + more, "K") for i, j in _STEPS.get(turns.lower(), {}).items()]
        moves += [(i, j, REROLE + more, "R") for r in "ua" for i, j in _STEPS[r].items()]
    return times(times(INSERTIONS, _matrix(moves)), INSERTIONS)


def product(turns: str) -> Matrix:
    """Of turns by their signs: ``-`` can only be deleted, else the initial s, u, a or x, a capital if truncated."""
    level = [_product(turns[k : k + _BLOCK]) for k in range(0, len(turns), _BLOCK)]
    while len(level) > 1:
        level = [times(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else NOTHING


def best(m: Matrix) -> tuple[int, str]:
    """The cheapest way from nothing to nothing or to the end of an answer."""
    return min(x for x in (m[0][0], m[0][3]) if x)


def _blank(text: str | Column) -> Column:
    return F.length(F.btrim(text, F.lit(_WHITE))) == 0


def prepared(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, digest), nulls as one space; ``copies`` is 1 where there is no such column, 0 marks what is gone."""
    copies = F.col("copies").cast("bigint") if "copies" in turns.columns else F.lit(1).cast("bigint")
    out = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], copies.alias("copies"))
    return out.withColumn("digest", F.sha2("text", 256))


_KEY = ("conv_id", "turn", "role", "digest")
_SUMS = ("n", "blank", "duplicate", "truncated", "illegal")


def _signs(turns: DataFrame) -> DataFrame:
    """A narrow row for each different turn: how often it comes, its faults, and whether it is the first of its role and text."""
    last = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    narrow = turns.select(*_KEY, "copies", _blank("text").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    base = narrow.groupBy(*_KEY).agg(F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    # the first of each role and text, marked by an aggregation instead of a join: no key gathers its rows
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = base.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(order)["turn"].alias("turn"))
    both = base.withColumn("first", F.lit(False)).unionByName(first.withColumn("first", F.lit(True)), allowMissingColumns=True)
    return both.groupBy(*_KEY).agg(F.max("n").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("first").alias("first"))


def _segment(rows: list[dict]) -> dict:
    """What the rows of one conversation in one partition come to."""
    signs, initials = [], []
    out = dict.fromkeys((*_SUMS, "turns"), 0) | {"low": None, "high": None}
    for r in rows:
        n = r["n"]
        if not n:
            continue
        if r["turn"] is not None:
            out["turns"] += r["turn"] != out["high"]
            out["low"] = r["turn"] if out["low"] is None else out["low"]
            out["high"] = r["turn"]
        initial = r["role"][:1]
        fine = not r["blank"] and r["first"]
        sign = initial if initial in ("s", "u", "a") else "x"
        signs.append((sign.upper() if r["cut"] else sign) + "-" * (n - 1) if fine else "-" * n)
        out["n"] += n
        out["blank"] += n if r["blank"] else 0
        out["duplicate"] += 0 if r["blank"] else n - fine
        out["truncated"] += fine and r["cut"]
        out["illegal"] += (n - 1) + (bool(initials) and initials[-1] + initial not in _LEGAL)
        initials.append(initial)
    m = product("".join(signs))
    return out | {"opens": initials[0] if initials else None, "closes": initials[-1] if initials else None, "cost": [x and x[0] for line in m for x in line], "audit": [x and x[1] for line in m for x in line]}


def _both(a: dict, b: dict) -> dict:
    """Two parts of a conversation, one after the other."""
    if not a["n"] or not b["n"]:
        return (b if b["n"] else a) | {"part": a["part"]}
    square = lambda s: tuple(tuple(c if c is None else (c, t) for c, t in zip(s["cost"][4 * i : 4 * i + 4], s["audit"][4 * i : 4 * i + 4])) for i in range(4))
    m = times(square(a), square(b))
    out = {c: a[c] + b[c] for c in _SUMS}
    out["illegal"] += a["closes"] + b["opens"] not in _LEGAL
    out["turns"] = a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"])
    out |= {"low": a["low"] if a["low"] is not None else b["low"], "high": b["high"] if b["high"] is not None else a["high"], "opens": a["opens"], "closes": b["closes"]}
    return out | {"conv_id": a["conv_id"], "part": a["part"], "border": True, "cost": [x and x[0] for line in m for x in line], "audit": [x and x[1] for line in m for x in line]}


def _grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Runs of rows with equal keys."""
    held: list[dict] = []
    for batch in batches:
        for row in (r for k in range(0, batch.num_rows, 4096) for r in batch.slice(k, 4096).to_pylist()):
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _packed(rows: Iterator[dict], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x or "") for x in row.get("audit") or ()) + len(row.get("text") or "")
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(df: DataFrame, *columns: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(c, to_arrow_type(df.schema[c].dataType)) for c in columns]


def plans(turns: DataFrame) -> DataFrame:
    """Per conversation: gaps of turns, blank, duplicate, truncated and illegal turns, and the cheapest edits: cost and audit."""
    signs = _signs(prepared(turns))
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = {f.name: f.dataType.simpleString() for f in signs.schema.fields}
    numbers = [*_SUMS, "turns"]
    fields = _arrow(signs, "conv_id") + [pa.field("part", pa.int32()), pa.field("border", pa.bool_())] + [pa.field(c, pa.int64()) for c in numbers]
    fields += [pa.field(c, f.type) for f in _arrow(signs, "turn") for c in ("low", "high")] + [pa.field(c, pa.string()) for c in ("opens", "closes")]
    schema = pa.schema([*fields, pa.field("cost", pa.list_(pa.int64())), pa.field("audit", pa.list_(pa.string()))])
    ddl = f"conv_id {kind['conv_id']}, part INT, border BOOLEAN, " + ", ".join(f"{c} BIGINT" for c in numbers) + f", low {kind['turn']}, high {kind['turn']}, opens STRING, closes STRING, cost ARRAY<BIGINT>, audit ARRAY<STRING>"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[dict]:
            before = None
            for held in _grouped(batches, "conv_id"):
                if before is not None:
                    yield before
                first = before is None
                before = _segment(held) | {"conv_id": held[0]["conv_id"], "part": part, "border": first}
            if before is not None:
                yield before | {"border": True}

        return _packed(rows(), schema)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for held in _grouped(batches, "conv_id", "group"):
                for r in held:
                    del r["group"]
                while len(held) > 1:
                    held = [_both(*held[k : k + 2]) if k + 1 < len(held) else held[k] for k in range(0, len(held), 2)]
                yield held[0]

        return _packed(rows(), schema)

    # read by both branches below, so written once
    told = materialise(signs.repartitionByRange(parts, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(segments, ddl), "conversation-segments")
    edge, width = told.where("border"), 1
    while width < parts:
        width *= _FAN
        edge = edge.withColumn("group", F.expr(f"part div {width}")).repartition("conv_id", "group").sortWithinPartitions("conv_id", "part").mapInArrow(reduced, ddl)
    out = told.where("NOT border").unionByName(edge)
    # states 0 and 3 are ends; the first row of the matrix begins with nothing
    end = F.array_min(F.filter(F.array(*[F.struct(F.col("cost")[k].alias("cost"), F.col("audit")[k].alias("audit")) for k in (0, 3)]), lambda x: x["cost"].isNotNull()))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    return out.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", end["cost"].alias("cost"), end["audit"].alias("audit"))


def repaired(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the turns that stand after the edits, each conversation's in order within one partition."""
    rows = prepared(turns).where("copies > 0").withColumn("audit", F.lit(None).cast("string"))
    both = rows.unionByName(plan.select("conv_id", "audit"), allowMissingColumns=True).withColumn("kind", F.col("audit").isNull().cast("int"))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "audit", "role", "text", "copies")
    schema = pa.schema([*_arrow(both, "conv_id"), pa.field("place", pa.int64()), pa.field("edit", pa.string()), pa.field("role", pa.string()), pa.field("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walked() -> Iterator[dict]:
            conv, audit, at, place, state = None, "", 0, 0, 0

            def put(edit: str, role: str, text: str) -> dict:
                nonlocal place, state
                place, state = place + 1, _STEPS[role[0]][state]
                return {"conv_id": conv, "place": place - 1, "edit": edit, "role": role, "text": text}

            def inserted() -> Iterator[dict]:
                nonlocal at
                while audit[at : at + 1] == "I":
                    at += 1
                    yield put("I", "assistant" if state == 2 else "user", "")

            for batch in batches:
                for r in (x for k in range(0, batch.num_rows, 1024) for x in batch.slice(k, 1024).to_pylist()):
                    if r["audit"] is not None:
                        yield from inserted()
                        conv, audit, at, place, state = r["conv_id"], r["audit"], 0, 0, 0
                        continue
                    for _ in range(r["copies"]):
                        yield from inserted()
                        edit = audit[at]
                        at += 1
                        if edit == "K":
                            yield put(edit, r["role"], r["text"])
                        elif edit == "R":
                            yield put(edit, "assistant" if state == 2 else "user", r["text"])
            yield from inserted()

        return _packed(walked(), schema)

    return both.mapInArrow(work, f"conv_id {both.schema['conv_id'].dataType.simpleString()}, place BIGINT, edit STRING, role STRING, text STRING")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired`` rows, hashed as they pass."""
    schema = pa.schema([*_arrow(rows, "conv_id"), pa.field("repaired_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[dict]:
            conv, state = None, None
            for batch in batches:
                for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text"))):
                    if not place:
                        if state:
                            yield {"conv_id": conv, "repaired_sha256": state.hexdigest()}
                        conv, state = c, hashlib.sha256()
                    state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if state:
                yield {"conv_id": conv, "repaired_sha256": state.hexdigest()}

        return _packed(hashed(), schema)

    return rows.mapInArrow(work, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 STRING")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by crc32 of ``conv_id:turn`` modulo 20: 0 gone, 1 emptied, 2 without ``.!?``, 3 there twice, 4 said by the user."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    k = F.col("__k")
    out = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("__k"))
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return out.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(table(spark, sf_dir, "conversations"))
    plan = plans(turns)
    hashes = digests(repaired(turns, plan)).withColumnRenamed("conv_id", "__conv")
    out = plan.join(hashes, plan["conv_id"].eqNullSafe(hashes["__conv"]), "left").drop("__conv")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
