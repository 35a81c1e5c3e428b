import hashlib
import itertools
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sweepgrid.llm import conversations as conv

GOOD = re.compile("(s?(ua)+)?").fullmatch


def all_repairs(signs, room=3):
    """Every sequence of edits with up to ``room`` insertions, by its definition: the cheapest, ties by ASCII."""
    out = []

    def walk(k, cost, audit, roles, left):
        if not re.compile("s?(ua)*u?").fullmatch(roles):
            return
        if k == len(signs) and GOOD(roles):
            out.append((cost, audit))
        if left:
            for r in "ua":
                walk(k, cost + 5, audit + "I", roles + r, left - 1)
        if k < len(signs):
            walk(k + 1, cost + 2, audit + "D", roles, left)
            if signs[k] != "-":
                more = 5 if signs[k].isupper() else 0
                if signs[k].lower() != "x":
                    walk(k + 1, cost + more, audit + "K", roles + signs[k].lower(), left)
                for r in "ua":
                    walk(k + 1, cost + more + 1, audit + "R", roles + r, left)

    walk(0, 0, "", "", room)
    return min(out)


@settings(max_examples=250, deadline=None)
@given(st.text("suaxSUAX-", max_size=6))
def test_product_is_the_cheapest_repair(signs):
    assert conv.best(conv.product(signs)) == all_repairs(signs)


@settings(max_examples=60, deadline=None)
@given(st.text("suaxSUAX-", max_size=60), st.lists(st.integers(0, 60), max_size=5))
def test_product_is_associative(signs, cuts):
    cuts = sorted({0, len(signs), *(c for c in cuts if c <= len(signs))})
    m = conv.NOTHING
    for a, b in itertools.pairwise(cuts):
        m = conv.times(m, conv.product(signs[a:b]))
    assert m == conv.product(signs)


def scanned(signs):
    """The same by a plain dynamic program over states, for long conversations."""
    steps, live = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}, {0: (0, "")}

    def insert(live):
        for _ in range(2):
            for r in "ua":
                for i, j in steps[r].items():
                    if i in live and (way := (live[i][0] + 5, live[i][1] + "I")) < live.get(j, (9**9, "")):
                        live[j] = way
        return live

    live = insert(live)
    for x in signs:
        new = {}
        for i, (cost, audit) in live.items():
            ways = [(i, cost + 2, audit + "D")]
            if x != "-":
                more = 5 if x.isupper() else 0
                ways += [(steps[x.lower()][i], cost + more, audit + "K")] if i in steps.get(x.lower(), ()) else []
                ways += [(steps[r][i], cost + more + 1, audit + "R") for r in "ua" if i in steps[r]]
            for j, c, a in ways:
                new[j] = min(new.get(j, (c, a)), (c, a))
        live = insert(new)
    return min(live[k] for k in (0, 3) if k in live)


def expected(rows):
    """The query's rows from the definition, row by row."""
    by = {}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by.setdefault(c, []).extend([(t is not None, t or 0, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda r: (*r[:3], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, signs, count = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in turns:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            x = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signs += "-" if fault in ("blank", "duplicate") else x.upper() if fault else x
        known = [t for ok, t, _, _ in turns if ok]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = scanned(signs)
        lines, state, it = [], 0, iter(turns)
        for e in audit:
            turn = None if e == "I" else next(it)
            if e == "D":
                continue
            role = turn[2] if e == "K" else "assistant" if state == 2 else "user"
            lines.append(f"{role}:{'' if e == 'I' else turn[3]}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out.append((c, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = ["Yes.", "No", "", None, " \t", "Why?\n", "Fine!  ", "é…", "long " * 3000 + ".", "Yes. "]
    rows = [(rng.choice([None, *range(150)]), rng.choice([None, *range(-2, 12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for _ in range(1200)]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"Turn {t}{rng.choice(['.', '', '?'])}") for t in range(3000)] + [(1001, 5, "user", "Same.")] * 40
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, copies STRING, Audit STRING"
    spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in conv.op11_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == expected(rows)
    assert {"K", "R", "D"} <= set("".join(r[7] for r in got))


def test_long_conversation_spreads_over_partitions(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"Text {t}{rng.choice(['.', '', '?', '!'])}") for t in range(20_000)]
    turns = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        row = conv.plans(turns).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    signs = "".join(r[2][0] if r[3][-1] in ".!?" else r[2][0].upper() for r in rows)
    assert len(row) == 1 and (row[0]["cost"], row[0]["audit"]) == scanned(signs)


def test_given_conversations(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in conv.op11_conversation_repair(spark, d).collect()), key=str)
    assert got == expected(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id BIGINT, turn BIGINT, role STRING, text STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    assert conv.op11_conversation_repair(spark, str(tmp_path)).count() == 0
