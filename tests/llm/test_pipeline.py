import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sweepgrid.llm import components, exact_dedup, mixing, near, packing, shared, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice(("an", "the", "or", "en", "ti", "re", "do", "el", "in")) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(400):
        text = [word() for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.2
        if toxic:
            text += ["idiot", "moron", "scum"]
        rows.append((i, " ".join(text), r.choice(["en", "de", None]), f"src{r.randint(0, 5)}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, rows[0][1] + "  ", "en", "src0", 0), (1001, rows[1][1].replace(" ", "\n"), "en", "src1", 0), (1002, None, "en", "src0", 0), (1003, "", None, None, 0)]
    long = [word() for _ in range(300)]
    rows += [(1010, " ".join(long), "en", "src0", 0), (1011, " ".join(long[:150] + ["changed"] + long[151:]), "en", "src0", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, names = {}, [n for n, _ in p.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_join", "mixing", "packing"]
    for name, stage in p.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = before, [r.asDict() for r in docs.collect()]
    before, after = seen["toxicity"]
    kept = {r["doc_id"] for r in after}
    assert all(("idiot" in (t or "").split()) == (d not in kept) for d, t in before.items())
    before, after = seen["exact_dedup"]
    same = {}
    for d, t in before.items():
        k = " ".join((t or "").split()) + ("|" if (t or "")[-1:].isspace() else "")
        same[k] = min(same.get(k, d), d)
    assert sorted(r["doc_id"] for r in after) == sorted(same.values())
    before, after = seen["near_join"]
    classes = {r.doc_id: r.class_id for r in near.near_join(spark.read.parquet(f"{folder}/out-exact_dedup")).collect()}
    assert {r["doc_id"] for r in after} == {d for d, c in classes.items() if c == d} and 1011 not in {r["doc_id"] for r in after}
    before, after = seen["mixing"]
    words = lambda t: len((t or "").split())
    assert sum(words(r["text"]) for r in after) == sum(map(words, before.values()))
    assert max(Counter(r["doc_id"] for r in after).values()) <= mixing.MAX_EPOCHS
    _, pieces = seen["packing"]
    at = 0
    for q in sorted(pieces, key=lambda q: (q["sequence_id"], q["offset"])):
        assert q["sequence_id"] * 2048 + q["offset"] == at
        at += q["length"]
    assert {q["doc_id"] for q in pieces} == {r["doc_id"] for r in after}


def test_run(spark, folder):
    """The whole run packs what the stages, one by one, leave: the same documents with as many tokens."""
    import corpus_pipeline as p
    from sweepgrid.llm.packing import default_tokenizer
    from tokenizers import Tokenizer

    got = [r.asDict() for r in p.run(spark, folder).collect()]
    left = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/out-mixing").collect()]  # written by test_stages
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = sorted((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in left)
    assert sorted((g["doc_id"], g["doc_tokens"]) for g in got if g["start"] == 0) == want
    assert sum(g["length"] for g in got) == sum(n for _, n in want)
    assert toxicity.THRESHOLD == 0.3


def test_columns_of_any_name_pass_through(spark, folder):
    import corpus_pipeline as p

    own = {"__row": 5, "__digest": "d", "__score": 0.5, "__n": 7, "__id": 8, "__taken": 9, "row": 1, "score": 2.0, "digest": "x", "place": 3, "class_id": 4, "label": "l"}
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40 OR doc_id >= 1000")
    for k, v in own.items():
        docs = docs.withColumn(k, F.lit(v))
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns[-len(own) :] == list(own), name
    rows = docs.collect()
    assert len(rows) > 20 and all(r[k] == v for r in rows for k, v in own.items())


def test_empty_and_odd_documents(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES:
        assert stage(spark, docs.where("false"), folder).collect() == [], name
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "you idiot moron scum", None, "s", 1), (5, "a b c d e f " * 20_000, "en", "s1", 2), (5, "a b c d e f " * 20_000, "en", "s1", 2)], docs.schema)
    for name, stage in p.STAGES[:-1]:
        odd = stage(spark, odd, folder)
    assert [r.doc_id for r in odd.where("doc_id IS NOT NULL").collect()] == [5]


def written(spark, monkeypatch, run):
    """The physical plan of every table that ``run`` writes on its way, by its name."""
    plans = []

    def spy(df, what, write=shared.materialise):
        plans.append((what, df._jdf.queryExecution().executedPlan()))
        return write(df, what)

    for module in (components, exact_dedup, mixing, near, packing, toxicity):
        monkeypatch.setattr(module, "materialise", spy)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows its exchanges
    try:
        out = run()
        plans.append(("result", out._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return plans


def nodes(plan):
    yield plan.nodeName()
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def python_in_a_task(plan, held=0):
    """The most Python nodes that stand in one another's stage."""
    name = plan.nodeName()
    held = 0 if "Exchange" in name else held + ("InArrow" in name)
    return max([held, *(python_in_a_task(plan.children().apply(i), held) for i in range(plan.children().size()))])


@pytest.mark.parametrize("stage", ["toxicity", "exact_dedup", "near_join", "mixing", "packing"])
def test_one_worker_a_task(spark, folder, monkeypatch, stage):
    """Each further Python node of a stage is a further worker for every task, which the executor keeps beside those of later stages."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plans = written(spark, monkeypatch, lambda: dict(p.STAGES)[stage](spark, docs, folder))
    assert {what: n for what, x in plans if (n := python_in_a_task(x)) > 1} == {}


def test_texts_move_alike_at_any_size(spark, folder, monkeypatch):
    """Texts are joined with what grows with the input by sort-merge also while that is small."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plans = dict(written(spark, monkeypatch, lambda: exact_dedup.keep_first(docs)))
    assert "SortMergeJoin" in set(nodes(plans["result"])) and not [n for n in nodes(plans["result"]) if n.startswith("Broadcast")]
    plans = dict(written(spark, monkeypatch, lambda: near.keep_one(docs)))
    for what in ("links", "result"):
        assert "SortMergeJoin" in set(nodes(plans[what]))
    assert not [n for n in nodes(plans["links"]) if n.startswith("Broadcast")]


def test_a_mix_reads_texts_once(spark, folder, monkeypatch):
    """Texts are read once for the counts and once for the mix and never shuffled, and only the counts and the leaves are written on the way:
    each file costs the executor two processes (chmod), which hold its memory until they have begun."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plans = written(spark, monkeypatch, lambda: mixing.keep_mix(docs))
    assert [what for what, _ in plans] == ["mixing", "leaves", "result"]
    below = lambda plan: [plan, *(x for i in range(plan.children().size()) for x in below(plan.children().apply(i)))]
    result = [p.nodeName() for p in below(plans[-1][1]) if "carried_1#" in p.output().mkString(",")]  # nodes that pass texts on
    assert sum("Scan" in n for n in result) == 1 and not [n for n in result if "Exchange" in n or "Union" in n]
    assert "regexp_extract_all" not in plans[0][1].toString()


def test_workers_hand_back_after_the_last_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(shared, "give_back", lambda: seen.append("given back"))
    for batch in shared.handing_back(lambda batches: (b * 2 for b in batches))(iter([1, 2])):
        seen.append(batch)
    assert seen == [2, 4, "given back"]
