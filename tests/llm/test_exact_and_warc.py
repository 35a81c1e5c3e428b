import hashlib
import os
import random
import zlib
from types import SimpleNamespace

import pytest
from sweepgrid.llm import exact_dedup, media, mixing, warc
from sweepgrid.llm.shared import shared_folder


def test_exact_dedup(spark):
    rows = [(3, "a  b"), (1, "a\n\tb"), (2, None), (5, ""), (7, " "), (8, "  "), (None, "a b"), (9, "x"), (9, "x"), (4, "a b ")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id BIGINT, text STRING, digest STRING, n INT")
    got = sorted((g.doc_id is not None, g.doc_id or 0, g.keep_id, g.group_size, g.kept, g.text_sha256) for g in exact_dedup.exact_dedup(docs).collect())
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([(True, 3, 1, 3, False, h("a b")), (True, 1, 1, 3, True, h("a b")), (True, 2, 2, 2, True, h("")), (True, 5, 2, 2, False, h("")), (True, 7, 7, 2, True, h(" ")), (True, 8, 7, 2, False, h(" ")), (False, 0, 1, 3, False, h("a b")), (True, 9, 9, 2, True, h("x")), (True, 9, 9, 2, True, h("x")), (True, 4, 4, 1, True, h("a b "))])
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(k.doc_id for k in kept.collect()) == [1, 2, 4, 7, 9]
    assert exact_dedup.exact_dedup(docs.where("false")).collect() == []


def test_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    one = spark.createDataFrame([(5, "a"), (6, "b"), (7, "b")], "doc_id BIGINT, text STRING")
    two = spark.createDataFrame([(1, "a"), (8, "c"), (9, "c")], "doc_id BIGINT, text STRING")
    assert sorted((g.doc_id, g.kept) for g in exact_dedup.exact_dedup(one, index).collect()) == [(5, True), (6, True), (7, False)]
    assert sorted((g.doc_id, g.keep_id, g.kept) for g in exact_dedup.exact_dedup(two, index).collect()) == [(1, 5, False), (8, 8, True), (9, 8, False)]
    assert index.table().count() == 3
    index.compact()
    assert sorted((r.digest, r.keep_id) for r in index.table().collect()) == sorted((hashlib.sha256(t.encode()).hexdigest(), k) for t, k in (("a", 5), ("b", 6), ("c", 8)))
    three = spark.createDataFrame([(1, "c", 7), (2, "d", 8), (2, "d", 9)], "doc_id BIGINT, text STRING, row INT")
    assert [(r.doc_id, r.text) for r in exact_dedup.keep_first(three, index).collect()] == [(2, "d")]
    index.drop()


def test_batches_meet_the_index_by_anti_join(spark, monkeypatch):
    """The second batch is anti-joined by sort-merge with what the first one stored, and none is left behind."""
    before, seen, add = spark.catalog.listTables(), [], exact_dedup.DigestIndex.add

    def watched(self, hashed, run=""):
        known = self.table()
        if known is not None:
            new = hashed.groupBy("digest").agg(exact_dedup.F.min("doc_id")).join(known.select("digest").hint("merge"), "digest", "left_anti")
            seen.append((known.count(), "SortMergeJoin" in new._jdf.queryExecution().executedPlan().toString()))
        else:
            seen.append((0, False))
        add(self, hashed, run)

    monkeypatch.setattr(exact_dedup.DigestIndex, "add", watched)
    docs = spark.createDataFrame([(i, f"t{i % 30}") for i in range(100)] + [(None, "t1"), (None, "new")], "doc_id BIGINT, text STRING")
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == 102 and all(g.keep_id == (1 if g.doc_id is None else g.doc_id) % 30 for g in got if g.keep_id is not None)
    assert seen == [(0, False), (30, True)] and spark.catalog.listTables() == before


def test_an_append_adds_one_file_a_bucket_however_many_partitions_keys_go_to(spark, monkeypatch):
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols, f=frame.repartition: f(self, max(n, 13), *cols))
    index = exact_dedup.DigestIndex(spark, buckets=4)
    for k, files in ((0, 4), (500, 8)):
        index.add(exact_dedup.digests(spark.createDataFrame([(k + i, f"t{k + i}") for i in range(300)], "doc_id BIGINT, text STRING")))
        assert len(index.table().inputFiles()) == files
    index.compact()
    assert len(index.table().inputFiles()) == 4 and index.table().count() == 600
    index.drop()


@pytest.mark.parametrize("ask", ["exact_dedup", "keep_first"])
@pytest.mark.parametrize("dies_after", [1, 2])
def test_a_run_that_died_after_its_appends_is_repeated(spark, monkeypatch, ask, dies_after):
    index, calls, add = exact_dedup.DigestIndex(spark, buckets=4), [], exact_dedup.DigestIndex.add
    exact_dedup.exact_dedup(spark.createDataFrame([(50, "old")], "doc_id BIGINT, text STRING"), index)
    docs = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)] + [(7, "old"), (30, "x" * 3_000_000), (31, "x" * 3_000_000)], "doc_id BIGINT, text STRING")
    answer = lambda: sorted(tuple(r)[:4] for r in getattr(exact_dedup, ask)(docs, index).collect())

    def dying(self, hashed, run=""):
        add(self, hashed, run)
        calls.append(run)
        if len(calls) == dies_after:
            raise RuntimeError("killed")

    monkeypatch.setattr(exact_dedup.DigestIndex, "add", dying)
    with pytest.raises(RuntimeError):
        answer()
    assert index.table().count() > 1
    monkeypatch.setattr(exact_dedup.DigestIndex, "add", add)
    got = answer()
    if ask == "keep_first":
        assert [(i, t[:2]) for i, t in got] == [(i, f"t{i}") for i in range(5)] + [(30, "xx")]
    else:
        assert [g[0] for g in got if g[3]] == [0, 1, 2, 3, 4, 30] and [g[:2] for g in got if g[0] == 7 and g[1] == 50]
    assert answer() == got and index.table().count() == 7  # and again, the same
    other = docs.where("doc_id < 3").withColumn("doc_id", exact_dedup.F.col("doc_id") + 100)
    assert exact_dedup.keep_first(other, index).count() == 0  # a run of its own keeps nothing that is known
    index.drop()


@pytest.mark.parametrize("step", range(4))
def test_compacting_may_die_at_any_step(spark, monkeypatch, step):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    for k in range(3):
        index.add(exact_dedup.digests(spark.createDataFrame([(i, f"t{i}") for i in range(10 * k, 10 * k + 15)], "doc_id BIGINT, text STRING")), str(k))
    rows, rename, recover = sorted(map(tuple, index.table().collect())), exact_dedup.DigestIndex._rename, exact_dedup.DigestIndex._recover
    done = []

    def dying(f):
        def run(self, *a):
            if f is recover and len(done) < 2:
                return f(self)
            if len(done) == step:
                raise RuntimeError("killed")
            done.append(1)
            return f(self, *a)

        return run

    monkeypatch.setattr(exact_dedup.DigestIndex, "_rename", dying(rename))
    monkeypatch.setattr(exact_dedup.DigestIndex, "_recover", dying(recover))
    if step < 3:
        with pytest.raises(RuntimeError):
            index.compact()
    else:
        index.compact()
    monkeypatch.setattr(exact_dedup.DigestIndex, "_rename", rename)
    monkeypatch.setattr(exact_dedup.DigestIndex, "_recover", recover)
    again = exact_dedup.DigestIndex(spark, index.name, 2)
    assert sorted(map(tuple, again.table().collect())) == rows
    again.compact()
    assert sorted(map(tuple, again.table().collect())) == rows
    again.drop()
    for left in ("_compacted", "_replaced"):
        spark.sql(f"DROP TABLE IF EXISTS {index.name}{left}")


def test_an_index_without_a_name_needs_no_warehouse(spark):
    """Its files lie in the shared folder, also where the warehouse is none that executors see, and leave with it."""
    own = exact_dedup.DigestIndex(spark, buckets=2)
    own.add(exact_dedup.digests(spark.createDataFrame([(k, f"t{k}") for k in range(20)], "doc_id BIGINT, text STRING")))
    own.compact()
    files, shared = own.table().inputFiles(), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert own.table().count() == 20 and all(f.removeprefix("file://").startswith(shared) for f in files)
    own.drop()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)

    settings = {"spark.sql.warehouse.dir": "spark-warehouse", "spark.checkpoint.dir": "file:///shared"}
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://head:7077"), conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d)))
    assert exact_dedup.DigestIndex(cluster).folder.startswith("file:///shared/")
    with pytest.raises(ValueError, match="warehouse"):
        exact_dedup.DigestIndex(cluster, "kept")


def test_extra_columns_of_any_name_come_through(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x", 7), (2, "a", 6, "y", 8), (3, "b", 7, None, 9)], "doc_id BIGINT, text STRING, row INT, Digest STRING, __row INT")
    assert sorted(tuple(r) for r in exact_dedup.keep_first(docs).collect()) == [(1, "a", 5, "x", 7), (3, "b", 7, None, 9)]


def test_warc_round_trip(spark):
    r = random.Random(2)
    big = ["".join(r.choice("abc<é>\r\n") for _ in range(3000)) for _ in range(3)]
    rows = [(i, f"http://x/{i}", r.choice(big + ["small", "", None])) for i in range(200)] + [(None, None, big[0]), (500, "u\r\nv", "x" * 999), (501, "u", "x" * 999), (502, "u", "y" * 1000), (503, "u", "y" * 1000), (503, "u", "y" * 1000)]
    pages = spark.createDataFrame([(*x, 9) for x in rows], "page_id BIGINT, url STRING, html STRING, length INT").repartition(3)
    index = warc.write_bundles(pages, shared_folder(spark, "t"), frame_bytes=5000, bundle_bytes=4000)
    got = sorted((str(g.page_id), g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in warc.resolved(warc.read_bundles(index)).collect())
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = best.get(h) if h else None
        revisit = to is not None and to != -1 and to != i
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert got == sorted(want)
    one = index.where("page_id = 502").first()
    head, body = warc.read_record(one.bundle, one.frame_at, one.frame_bytes, one.offset, one.length)
    assert head["WARC-Type"] == "revisit" and body == b"" and head["WARC-Refers-To"] == "<urn:page:503>"
    table = warc.seek_table(one.bundle)
    assert [t[0] for t in table] == sorted({x.frame_at for x in index.where(index.bundle == one.bundle).collect()})
    assert all(a[0] + a[1] == b[0] and a[2] + a[3] == b[2] for a, b in zip(table, table[1:]))
    assert warc.resolved(warc.read_bundles(warc.write_bundles(pages.where("false"), shared_folder(spark, "t")))).collect() == []


def test_media_round_trip(spark):
    r = random.Random(4)
    rows = [(1, None), (2, ""), (2, ""), (None, "é" * 100), (3, "x" * 64), (4, "\0" * 5), (5, "long " * 30_000)] + [(i, "".join(r.choice("abc é") for _ in range(r.randint(0, 500)))) for i in range(10, 60)]
    docs = spark.createDataFrame([(*x, "m") for x in rows], "doc_id BIGINT, text STRING, media STRING").repartition(3)
    folder = shared_folder(spark, "m")
    manifest = media.write_archives(docs, folder, archive_bytes=3000)
    members = media.read_archives(spark, folder, manifest, range_bytes=1500, batch_bytes=2000)
    found = media.described(members).collect()
    got = sorted((str(g.doc_id), g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) for g in found)
    want, of = [], {}
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want.append((str(d), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        of[hashlib.sha256(p).hexdigest(), len(raw)] = p
    assert got == sorted(want)
    # the stored images, by another decoder: samples of each row after its filter byte
    images = {}
    for m in members.collect():
        media_, at, idat = bytes(m.media), 8, b""
        while at < len(media_):
            n = int.from_bytes(media_[at : at + 4], "big")
            idat += media_[at + 8 : at + 8 + n] if media_[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + n
        lines = zlib.decompress(idat)
        images[hashlib.sha256(media_).hexdigest()] = b"".join(lines[k + 1 : k + 65] for k in range(0, len(lines), 65)), len(media_)
    for g in found:
        p, size = images[g.media_sha256]
        assert p == of[g.payload_sha256, g.n_bytes] and size == g.media_bytes
        mean = sum(p) / len(p)
        spread = (sum(x * x for x in p) / len(p) - mean * mean) ** 0.5 if len(set(p)) > 1 else 0.0
        shape, *stats = g.feature.split(";")
        assert shape == f"64x{len(p) // 64}" and abs(float(stats[0][5:]) - mean) < 1e-3 and abs(float(stats[1][4:]) - spread) < 1e-2
        assert [float(x) for x in stats[2].split(",")] == [pytest.approx(sum(x >> 6 == q for x in p) / len(p), abs=1e-3) for q in range(4)]
    # an archive that the manifest does not name, as a lost attempt leaves it, is not read
    stray = media.ArchiveWriter(f"{folder}/stray.zip")
    stray.add("0/77.png", media.encode_png(media.padded(b"x"), 1))
    stray.close()
    assert media.read_archives(spark, folder, manifest).count() == len(rows)
    assert media.read_archives(spark, folder).count() == len(rows) + 1
    assert media.described(media.read_archives(spark, shared_folder(spark, "none"))).collect() == []


def test_media_members_fail_by_themselves(tmp_path):
    path = str(tmp_path / "a.zip")
    w = media.ArchiveWriter(path)
    for k in range(3):
        w.add(f"0/{k}.png", media.encode_png(media.padded(b"%d" % k), 1))
    w.close()
    import zipfile

    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == ["0/0.png", "0/1.png", "0/2.png"]
        at = z.infolist()[1].header_offset
    raw = bytearray(open(path, "rb").read())
    raw[at + 60] ^= 255
    open(path, "wb").write(raw)
    reader = media.ArchiveReader({"path": str(tmp_path), "retries": "1"})
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert [(x["doc_id"], x["error"] is None, x["attempts"]) for x in rows] == [(0, True, 1), (1, False, 2), (2, True, 1)]
    with pytest.raises(ValueError):
        media.decode_png(b"none")


def test_media_ranges_open_their_archive_once(spark, tmp_path, monkeypatch):
    """One open a range and one more for each failed attempt; a range reads its own part of the directory."""
    docs = spark.createDataFrame([(i, "text %d " % i * (i % 40)) for i in range(200)], "doc_id BIGINT, text STRING").coalesce(1)
    folder = shared_folder(spark, "opened")
    manifest = media.write_archives(docs, folder, archive_bytes=20_000, range_bytes=4000)
    reader = media.ArchiveReader({"path": folder, "manifest": manifest, "retries": "2"})
    plain = media.open_fs
    opened, reads, failing = [], [], set()

    class File:
        def __init__(self, file):
            self.file = file

        def read_at(self, size, offset):
            reads.append(size)
            if offset in failing:
                failing.discard(offset)
                raise OSError("lost")
            return self.file.read_at(size, offset)

        def close(self):
            self.file.close()

    class Files:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            opened.append(path)
            return File(self.fs.open_input_file(path))

    planned = reader.partitions()
    monkeypatch.setattr(media, "open_fs", lambda uri: (Files(plain(uri)[0]), plain(uri)[1]))
    assert len({p.archive for p in planned}) > 1 and len(planned) > 2 * len({p.archive for p in planned})
    rows = [x for p in planned for b in reader.read(p) for x in b.to_pylist()]
    assert sorted(x["doc_id"] for x in rows) == list(range(200)) and len(opened) == len(planned)
    # for each range its part of the directory, then two reads a member
    assert len(reads) == len(planned) + 2 * 200
    opened.clear()
    failing |= {rows[3]["offset"]}
    again = [x for b in reader.read(planned[0]) for x in b.to_pylist()]
    assert [x["attempts"] for x in again if x["offset"] == rows[3]["offset"]] == [2] and all(x["error"] is None for x in again) and len(opened) == 2


def test_media_of_an_empty_table(spark):
    folder = shared_folder(spark, "bare")
    manifest = media.write_archives(spark.createDataFrame([], "doc_id BIGINT, text STRING"), folder)
    assert media.described(media.read_archives(spark, folder, manifest)).collect() == []


@pytest.mark.parametrize("fraction,epochs", [(1.0, 3), (0.3, 1), (9.0, 2)])
def test_mixing_budgets(spark, fraction, epochs):
    r = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 30))), r.choice(["en", "en", "de", None]), r.choice(["src0"] * 5 + ["src1", "src2", "src7", "own", None])) for i in range(400)] + [(None, "a b", "en", "src0"), (5, None, "en", "src0"), (3, "a b c", "en", "src0")]
    docs = spark.createDataFrame([(*x, "q", "z") for x in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, tokens STRING, leaf_budget STRING")
    got = mixing.mixed(docs, (), fraction, epochs).collect()
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    assert sum(g["__taken"] for g in got) == min(int(total * fraction), total * epochs)
    leaf = {}
    for g in got:
        k = g["__domain"], g["__lang"], g["__source"]
        leaf.setdefault(k, [0, g["__budget"], 0])
        leaf[k][0] += g["__taken"]
        leaf[k][2] += g["__taken"] < g["__n"]
    assert all(a == b and cut <= 1 for a, b, cut in leaf.values())
    again = mixing.mixed(docs.repartition(7), (), fraction, epochs, broadcast_leaves=0).collect()
    key = lambda rows: sorted((str(g["__id"]), g["__epoch"], g["__taken"]) for g in rows)
    assert key(again) == key(got)
    assert mixing.mixed(docs.where("false")).collect() == []
    kept = mixing.keep_mix(docs, fraction=0.5)
    assert kept.columns == docs.columns and sum(len(k.text.split()) for k in kept.collect()) == int(total * 0.5)


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_mixing_cuts_between_equal_rows(spark, broadcast):
    """A cut that falls among rows of equal id and text takes each of them once, and whatever stands between words is no token."""
    same = [(7, " a\tb\x0b\nc\u00a0c d ", "en", "src0")] * 5
    docs = spark.createDataFrame([*same, (8, " \n\t", "en", "src0"), (9, None, "en", "src0"), (10, "\U0001f600", "en", "src0")], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    for fraction in (0.3, 0.5, 0.95, 1.5):
        got = mixing.mixed(docs, (), fraction, 3, broadcast_leaves=broadcast).collect()
        whole, rest = divmod(int(21 * fraction), 21)
        assert {(g["__id"], g["__n"]) for g in got} <= {(7, 4), (10, 1)}
        for epoch, tokens in [*((e, 21) for e in range(whole)), (whole, rest)]:
            taken = [(g["__taken"], g["__n"]) for g in got if g["__epoch"] == epoch]
            assert sum(t for t, _ in taken) == tokens and sum(t < n for t, n in taken) <= 1 and all(t > 0 for t, _ in taken)
        assert len(got) <= 6 * (whole + 1)
