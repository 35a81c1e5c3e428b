"""Queries that read the whole table: every point is on one side or the other."""

from pyspark.sql import functions as F

from sweepgrid.plans import catalogue
from sweepgrid.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_map_merge_holds_every_point(spark):
    merged = catalogue.queries()["q_map_merge"](spark, SF)
    assert merged.agg(F.sum("n")).first()[0] == fx.points(spark, SF).count()


def test_nn_truth_reads_every_row(spark):
    """Brute force over all pairs of a labelled point and any other row."""
    points = [r.asDict() for r in fx.points(spark, SF).collect()]
    truth = {}
    for t in points:
        if t["ok"] % 3:
            truth.setdefault(t["frame"], []).append(t)
    want, thirds = {}, set()
    for p in (p for p in points if p["ok"] % 3 == 0):
        near = [((p["x"] - t["x"]) ** 2 + (p["y"] - t["y"]) ** 2 + (p["z"] - t["z"]) ** 2, t["ok"] * 10 + t["ln"], t["lab"], t["ok"] % 3) for t in truth.get(p["frame"], [])]
        best = min((n for n in near if n[0] <= 0.25), default=(None, None, 7, None))
        want[p["ok"], p["pk"], p["sk"], p["ln"]] = best[2]
        thirds.add(best[3])
    got = {(r.ok, r.pk, r.sk, r.ln): r.cls for r in catalogue.queries()["q_nn_truth"](spark, SF).collect()}
    assert got == want and thirds >= {1, 2}


def test_pieces_make_the_document(spark, monkeypatch):
    """Pieces of six points; the document is what pandas makes of the whole sweep."""
    import base64

    import numpy as np
    import pandas as pd
    from sweepgrid.sources import sinks

    monkeypatch.setattr(sinks, "PIECE", 6)
    r = np.random.default_rng(3)
    t = pd.DataFrame({"frame": [0] * 40 + [7] * 6 + [8], "ok": r.permutation(47), "ln": 1, **dict(zip("xyz", r.uniform(-40, 40, (3, 47)))), "lab": r.integers(0, 255, 47)})
    points, want = spark.createDataFrame(t), {}
    for frame, own in t.sort_values(["ok", "ln"]).groupby("frame"):
        xyz = np.clip(np.round(own[["x", "y", "z"]].to_numpy() * 50.0), -32768, 32767).astype("<i2")
        want[frame] = pd.Series({"frame": int(frame), "n": len(own), "scale": 50.0, "xyz": base64.b64encode(xyz.tobytes()).decode(), "cls": base64.b64encode(own["lab"].to_numpy().astype("u1").tobytes()).decode()}).to_json()
    pieces = sinks.document_pieces(points, ["ok", "ln"]).collect()
    assert max(len(p.text) for p in pieces if p.section in (1, 3)) <= 2 * 48 and len(pieces) == 2 * (7 + 1 + 1) + 9
    assert {g.frame: g.document for g in sinks.exported(points, ["ok", "ln"]).collect()} == want


def test_nearest_points_by_tiles(spark):
    """Ties, ids that occur twice, points without a place or a key; a loop over all pairs says what is nearest."""
    import numpy as np
    from sweepgrid.operators import evaluate

    r = np.random.default_rng(4)
    place = lambda n, wide: (r.integers(-wide, wide, (n, 3)) / 8).tolist()
    p = [(int(k % 2), k // 2 if k < 40 else k, *v) for k, v in enumerate(place(300, 40))] + [(0, 900, None, 0.0, 0.0), (None, 901, 0.0, 0.0, 0.0)]
    t = [(int(k % 2), k % 90, k % 5, *v) for k, v in enumerate(place(500, 12) + place(900, 40))] + [(None, 1, 1, 0.0, 0.0, 0.0), (0, 1, 1, None, 0.0, 0.0)]
    want = {}
    for f, i, *v in p:
        near = [(sum((a - b) ** 2 for a, b in zip(v, w)), tid, lab) for g, tid, lab, *w in t if None not in (f, g, v[0], w[0]) and f == g]
        want[f, i] = min([n for n in near if n[0] <= 1.0] + ([want[f, i]] if want.get((f, i)) else []), default=None)
    place = "x DOUBLE, y DOUBLE, z DOUBLE"
    got = evaluate.nearest(spark.createDataFrame(p, f"frame INT, id INT, {place}"), spark.createDataFrame(t, f"frame INT, tid INT, lab INT, {place}"), ["frame"], 1.0, ["id"], ["tid", "lab"])
    assert "Generate explode(array(-1, 0, 1)" not in got._jdf.queryExecution().toString() and got.columns == ["frame", "id", "x", "y", "z", "d2", "t_tid", "t_lab"]
    rows = got.collect()
    assert len(rows) == len(p) and {(g.frame, g.id): None if g.d2 is None else (g.d2, g.t_tid, g.t_lab) for g in rows} == want
    assert sum(v is not None for v in want.values()) > 100
