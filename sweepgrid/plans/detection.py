"""Queries of labels, boxes, clusters and detection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.functions import geometry as geo
from sweepgrid.operators import cluster, evaluate, quality, sectors, tables, tiles
from sweepgrid.plans.mapping import EXTRINSIC, PTS, WIDE
from sweepgrid.sources import fixtures as fx
from sweepgrid.sources import sinks
from sweepgrid.sources.workspace import written

QUERIES, ORACLES = {}, {}


def _add(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


_LUT = "lut(raw, cls, moving) AS (VALUES (0, 0, false), (1, 1, false), (2, 2, false), (3, 3, false), (4, 4, false), (5, 5, true), (6, 6, true))"


@_add("q_labels_lut", f"WITH {PTS}, {_LUT} SELECT coalesce(cls, 7)::INT AS cls, coalesce(moving, false) AS moving, count(*) AS n, sum(z) AS sz FROM points LEFT JOIN lut ON lab = raw GROUP BY ALL")
def labels_lut(spark: SparkSession, d: str) -> DataFrame:
    """Raw labels to grid classes by a table; unknown ones are the last class."""
    lut = spark.createDataFrame([(k, k, k >= 5) for k in range(7)], "raw INT, cls INT, moving BOOLEAN")
    p = fx.points(spark, d).join(lut, F.col("lab") == F.col("raw"), "left")
    return p.groupBy(F.coalesce("cls", F.lit(7)).alias("cls"), F.coalesce("moving", F.lit(False)).alias("moving")).agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("sz"))


@_add("q_class_counts", f"WITH {PTS} SELECT frame, lab AS cls, count(*) AS n FROM points GROUP BY ALL")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return fx.points(spark, d).groupBy("frame", F.col("lab").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


_IN_BOX = f"""WITH {WIDE}, {fx.boxes_sql()}, m AS (SELECT id, b.frame, cls, ok, pk, sk, ln, lab, cos(yaw)*(x-cx) + sin(yaw)*(y-cy) AS u, cos(yaw)*(y-cy) - sin(yaw)*(x-cx) AS v, z-cz AS w, l, b.w AS wd, h FROM boxes b JOIN points p ON p.frame = b.frame AND p.x BETWEEN cx-4 AND cx+4 AND p.y BETWEEN cy-4 AND cy+4)
SELECT id, frame, cls, count(*) AS n, count(*) FILTER (lab = 6) AS walkers FROM m WHERE abs(u) <= l/2 + 0.1 AND abs(v) <= wd/2 + 0.1 AND abs(w) <= h/2 + 0.1 GROUP BY ALL"""


@_add("q_points_in_box", _IN_BOX)
def points_in_box(spark: SparkSession, d: str) -> DataFrame:
    boxes, kinds = fx.boxes(spark, d), evaluate.different(fx.boxes(spark, d), ["frame"])
    hit = evaluate.points_in_boxes(fx.points(spark, d, fx.WIDE), kinds, ["frame"], 0.1)
    held = hit.groupBy("frame", "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lab") == 6).alias("walkers"))
    return evaluate.of_equals(boxes, kinds, held, ["frame"]).select("id", "frame", "cls", "n", "walkers")


@_add("q_box_buckets_sql", _IN_BOX)
def box_buckets_sql(spark: SparkSession, d: str) -> DataFrame:
    """The same in SQL, with the table function that deals a box to its buckets."""
    tables.register(spark)
    boxes = fx.boxes(spark, d)
    kinds = evaluate.different(boxes, ["frame"]).withColumn("cls", F.lit(0))
    held = spark.sql("""WITH dealt AS (SELECT b.*, t.bx, t.by FROM {boxes} b, LATERAL box_buckets(b.cx, b.cy, b.l, b.w, 0.1D, 4.0D) t),
        held AS (SELECT d.id, d.frame, d.cls, p.lab, p.z - d.cz AS up, d.l, d.w, d.h, cos(d.yaw) * (p.x - d.cx) + sin(d.yaw) * (p.y - d.cy) AS u, cos(d.yaw) * (p.y - d.cy) - sin(d.yaw) * (p.x - d.cx) AS v
                 FROM {points} p JOIN dealt d ON d.frame = p.frame AND d.bx = floor(p.x / 4) AND d.by = floor(p.y / 4))
        SELECT id, frame, cls, count(*) AS n, count_if(lab = 6) AS walkers FROM held WHERE abs(u) <= l / 2 + 0.1D AND abs(v) <= w / 2 + 0.1D AND abs(up) <= h / 2 + 0.1D GROUP BY id, frame, cls""", boxes=kinds, points=fx.points(spark, d, fx.WIDE))
    return evaluate.of_equals(boxes, kinds, held.drop("cls"), ["frame"]).select("id", "frame", "cls", "n", "walkers")


@_add("q_sweep_clusters_sql")
def sweep_clusters_sql(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of each sweep's obstacles by the table function, from SQL; a test holds them against ``cluster_points``."""
    tables.register(spark)
    above = sectors.ground_points(fx.points(spark, d), ("frame",)).where("NOT ground").select("frame", "x", "y", "z")
    return spark.sql("SELECT * FROM sweep_clusters(TABLE({above}), 0.35D, 8, 6000)", above=above)


@_add("q_box_corners", f"WITH {fx.boxes_sql()}, k(i, sx, sy, sz) AS (VALUES (0, 1, 1, -1), (1, 1, -1, -1), (2, -1, -1, -1), (3, -1, 1, -1), (4, 1, 1, 1), (5, 1, -1, 1), (6, -1, -1, 1), (7, -1, 1, 1)) SELECT id, i, round(cx + cos(yaw)*l*(sx/2.0::DOUBLE) - sin(yaw)*w*(sy/2.0::DOUBLE), 6) + 0.0 AS x, round(cy + sin(yaw)*l*(sx/2.0::DOUBLE) + cos(yaw)*w*(sy/2.0::DOUBLE), 6) + 0.0 AS y, round(cz + h*(sz/2.0::DOUBLE), 6) + 0.0 AS z FROM boxes, k")
def box_corners(spark: SparkSession, d: str) -> DataFrame:
    b = fx.boxes(spark, d)
    c = b.select("id", F.posexplode(geo.corners({k: F.col(k) for k in evaluate.BOX})).alias("i", "p"))
    return c.select("id", "i", *[(F.round(f"p.{k}", 6) + 0.0).alias(k) for k in "xyz"])


_NN = f"""WITH {PTS}, p AS (SELECT * FROM points WHERE ok % 3 = 0), t AS (SELECT frame, x, y, z, lab, ok*10 + ln AS tid FROM points WHERE ok % 3 <> 0),
j AS (SELECT p.ok, p.pk, p.sk, p.ln, (p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y)+(p.z-t.z)*(p.z-t.z) AS d2, t.lab, t.tid FROM p JOIN t ON p.frame = t.frame AND abs(p.x-t.x) <= 0.5 AND abs(p.y-t.y) <= 0.5),
b AS (SELECT ok, pk, sk, ln, min({{'d2': d2, 'tid': tid, 'lab': lab}}) AS best FROM j WHERE d2 <= 0.25 GROUP BY ALL) SELECT p.ok, p.pk, p.sk, p.ln, best.d2 AS d2, coalesce(best.lab, 7)::INT AS cls FROM p LEFT JOIN b USING (ok, pk, sk, ln)"""


@_add("q_nn_truth", _NN)
def nn_truth(spark: SparkSession, d: str) -> DataFrame:
    """A third of the cloud takes its class from the nearest of all the rest, within half a metre."""
    p = fx.points(spark, d)
    t = p.where("ok % 3 <> 0").withColumn("tid", F.col("ok") * 10 + F.col("ln"))
    out = evaluate.nearest(p.where("ok % 3 = 0"), t, ["frame"], 0.5, ["ok", "pk", "sk", "ln"], ["tid", "lab"])
    return out.select("ok", "pk", "sk", "ln", "d2", F.coalesce("t_lab", F.lit(7)).alias("cls"))


_LABELS = "labels3 AS (SELECT p_partkey AS id, (p_partkey % 41 - 20)*1.0::DOUBLE AS cx, 1.5::DOUBLE + (p_partkey % 4)/8.0::DOUBLE AS cy, 5.0::DOUBLE + p_partkey % 37 AS cz, 1.5::DOUBLE AS h, 1.0::DOUBLE + (p_partkey % 4)/4.0::DOUBLE AS w, 2.0::DOUBLE + (p_partkey % 8)/4.0::DOUBLE AS l, (p_partkey % 25 - 12)*0.25::DOUBLE AS ry FROM part)"


@_add("q_label_boxes", f"WITH {_LABELS}, c AS (SELECT *, cx + 0.004 AS a, cy - h/2 + 0.076 AS b, cz + 0.27 AS e, -ry - pi()/2 + pi() AS s FROM labels3) SELECT id, round(e, 6) AS cx, round(-a, 6) + 0.0 AS cy, round(-b, 6) + 0.0 AS cz, l, w, h, round(s - floor(s/(2*pi()))*(2*pi()) - pi(), 6) + 0.0 AS yaw FROM c")
def label_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Objects labelled in the camera's frame as boxes of the sensor's."""
    k = F.col("p_partkey")
    o = fx.table(spark, d, "part").select(k.alias("id"), ((k % 41 - 20) * F.lit(1.0)).alias("cx"), (F.lit(1.5) + k % 4 / F.lit(8.0)).alias("cy"), (F.lit(5.0) + k % 37).alias("cz"), F.lit(1.5).alias("h"), (F.lit(1.0) + k % 4 / F.lit(4.0)).alias("w"), (F.lit(2.0) + k % 8 / F.lit(4.0)).alias("l"), ((k % 25 - 12) * F.lit(0.25)).alias("ry"))
    box = geo.label_box([[1, 0, 0], [0, 1, 0], [0, 0, 1]], EXTRINSIC)
    return o.select("id", *[e.alias(c) if c in "lwh" else (F.round(e, 6) + 0.0).alias(c) for c, e in box.items()])


@_add("q_heading_bins", f"WITH {fx.boxes_sql()}, y AS (SELECT id, yaw - 1.2::DOUBLE + (id % 17) * 0.11::DOUBLE AS a FROM boxes), w AS (SELECT *, 2*pi()/12 AS w FROM y), m AS (SELECT *, a + w/2 - floor((a + w/2)/(2*pi()))*(2*pi()) AS s FROM w), b AS (SELECT *, cast(floor(s/w) as int) % 12 AS bin FROM m), r AS (SELECT *, a - bin*w + pi() AS q FROM b) SELECT id, bin, round((q - floor(q/(2*pi()))*(2*pi()) - pi())/w, 6) + 0.0 AS residual FROM r")
def heading_bins(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("yaw") - F.lit(1.2) + F.col("id") % 17 * F.lit(0.11)
    b, r = geo.encode_heading(a)
    return fx.boxes(spark, d).select("id", b.alias("bin"), (F.round(r, 6) + 0.0).alias("residual"))


_E3 = "e AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])


_YAW = """m AS (SELECT label, count(*) n, avg(x) mx, avg(y) my FROM e GROUP BY ALL), d AS (SELECT e.*, x-mx dx, y-my dy, n, mx, my FROM e JOIN m USING (label)),
s AS (SELECT label, sum(dx*dx) a, sum(dx*dy) b, sum(dy*dy) c FROM d GROUP BY ALL), v AS (SELECT *, (a+c)/2 + sqrt(greatest((a+c)/2*((a+c)/2) - (a*c-b*b), 0)) AS lam FROM s),
k AS (SELECT v.label, sum(pow(dx*(lam-c) + dy*b, 3)) AS skew FROM d JOIN v USING (label) GROUP BY ALL),
yaw AS (SELECT label, n, mx, my, atan2(CASE WHEN skew < 0 THEN -1 ELSE 1 END*b, CASE WHEN skew < 0 THEN -1 ELSE 1 END*(lam-c)) AS yaw FROM v JOIN k USING (label) JOIN m USING (label))"""


@_add("q_pca_yaw", f"WITH {_E3}, {_YAW} SELECT label, n, round(yaw, 6) + 0.0 AS yaw FROM yaw")
def pca_yaw(spark: SparkSession, d: str) -> DataFrame:
    return cluster.pca_yaw(_embedded(spark, d), ["label"]).select("label", "n", (F.round("yaw", 6) + 0.0).alias("yaw"))


@_add("q_instances", f"""WITH {_E3}, {_YAW}, r AS (SELECT e.label, n, e.z, cos(yaw)*(x-mx) + sin(yaw)*(y-my) AS u, cos(yaw)*(y-my) - sin(yaw)*(x-mx) AS v FROM e JOIN yaw USING (label) WHERE n >= 20 AND sqrt(mx*mx+my*my) >= 0.0)
SELECT label, n, round((min(z)+max(z))/2, 6) + 0.0 AS cz, round(max(u)-min(u), 6) AS l, round(max(v)-min(v), 6) AS w, round(max(z)-min(z), 6) AS h FROM r GROUP BY ALL""")
def instances(spark: SparkSession, d: str) -> DataFrame:
    out = quality.actors(_embedded(spark, d), ["label"], 20, 0.0)
    return out.select("label", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("cz", "l", "w", "h")])


@_add("q_canonical", f"""WITH {_E3}, {_YAW}, t AS (SELECT e.id, e.label, e.x, e.y, e.z, yaw, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, z - avg(z) OVER w AS dz FROM e JOIN yaw USING (label) WINDOW w AS (PARTITION BY e.label)),
r AS (SELECT *, cos(yaw)*dx + sin(yaw)*dy AS u, cos(yaw)*dy - sin(yaw)*dx AS v FROM t), sc AS (SELECT *, greatest(sqrt(max(u*u+v*v+dz*dz) OVER (PARTITION BY label)), 1e-6) AS s FROM r)
SELECT id, label, round(u/s, 6) + 0.0 AS fx, round(v/s, 6) + 0.0 AS fy, round(dz/s, 6) + 0.0 AS fz, round(sqrt(x*x+y*y+z*z)/50.0, 6) AS frange FROM sc""")
def canonical(spark: SparkSession, d: str) -> DataFrame:
    e = _embedded(spark, d)
    f = cluster.canonical(e, cluster.pca_yaw(e, ["label"]), ["label"])
    return f.select("id", "label", *[(F.round(c, 6) + 0.0).alias(c) for c in ("fx", "fy", "fz", "frange")])


@_add("q_chamfer", f"""WITH {_E3}, a AS (SELECT * FROM e WHERE id % 2 = 0), b AS (SELECT * FROM e WHERE id % 2 = 1), j AS (SELECT a.label, a.id ia, b.id ib, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) d FROM a JOIN b USING (label)),
o AS (SELECT label, avg(d) d FROM (SELECT label, ia, min(d) d FROM j GROUP BY ALL) GROUP BY ALL), t AS (SELECT label, avg(d) d FROM (SELECT label, ib, min(d) d FROM j GROUP BY ALL) GROUP BY ALL) SELECT label, round((o.d+t.d)/2, 6) AS chamfer FROM o JOIN t USING (label)""")
def chamfer(spark: SparkSession, d: str) -> DataFrame:
    e = _embedded(spark, d)
    return evaluate.chamfer(e.where("id % 2 = 0"), e.where("id % 2 = 1"), "label").select("label", F.round("chamfer", 6).alias("chamfer"))


_PRED = "CASE WHEN event_id % 11 = 0 THEN 'view' WHEN event_id % 13 = 0 THEN 'click' ELSE event_type END"


@_add("q_confusion_prf", f"""WITH c AS (SELECT event_type AS truth, {_PRED} AS predicted, count(*) n FROM events GROUP BY ALL), t AS (SELECT truth cls, sum(n) support, sum(CASE WHEN truth = predicted THEN n ELSE 0 END) tp FROM c GROUP BY ALL), p AS (SELECT predicted cls, sum(n) found FROM c GROUP BY ALL),
o AS (SELECT cls, coalesce(tp, 0)::BIGINT tp, coalesce(support, 0)::BIGINT support, coalesce(found, 0)::BIGINT found FROM t FULL JOIN p USING (cls)), q AS (SELECT *, tp/greatest(found, 1) AS precision, tp/greatest(support, 1) AS recall FROM o)
SELECT cls, tp, support, found, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0 END, 9) AS f1 FROM q""")
def confusion_prf(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events").withColumn("predicted", F.expr(_PRED))
    out = evaluate.precision_recall(evaluate.confusion(e, "event_type", "predicted"))
    return out.select("cls", "tp", "support", "found", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@_add("q_prf_bands", """WITH c AS (SELECT doc_id % 4 AS band, count(*) FILTER (quality = 1 AND toxic = 1) tp, count(*) FILTER (quality <> 1 AND toxic = 1) fp, count(*) FILTER (quality = 1 AND toxic <> 1) fn, count(*) FILTER (quality <> 1 AND toxic <> 1) tn FROM labels GROUP BY GROUPING SETS ((doc_id % 4), ()))
SELECT band, tp, fp, fn, tn, round(tp/greatest(tp+fp, 1), 9) AS precision, round(tp/greatest(tp+fn, 1), 9) AS recall, round(2*tp/greatest(2*tp+fp+fn, 1), 9) AS f1, round(tp/greatest(tp+fp+fn, 1), 9) AS iou, round((tp+tn)/greatest(tp+fp+fn+tn, 1), 9) AS accuracy FROM c""")
def prf_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "labels").withColumn("band", F.col("doc_id") % 4)
    out = evaluate.binary_scores(rows, "band", F.col("quality") == 1, F.col("toxic") == 1)
    return out.select("band", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "iou", "accuracy")])


_SCORED = "s AS (SELECT user_id % 5 AS grp, event_id, value AS score, event_type = 'purchase' AS tp FROM events), n AS (SELECT grp, count(*) FILTER (tp) AS n_gt FROM s GROUP BY ALL), k AS (SELECT s.grp, s.event_id, n_gt, row_number() OVER w AS rn, sum(tp::INT) OVER w AS ctp FROM s JOIN n USING (grp) WINDOW w AS (PARTITION BY s.grp ORDER BY score DESC, event_id)), c AS (SELECT *, ctp/n_gt AS recall, ctp/rn AS precision FROM k)"


def _curve(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "events").select((F.col("user_id") % 5).alias("grp"), "event_id", F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("tp"))
    n = s.groupBy("grp").agg(F.count_if("tp").alias("n_gt"))
    return evaluate.pr_curve(s.join(n, "grp"), ["grp"], "event_id")


@_add("q_pr_curve", f"WITH {_SCORED} SELECT grp, event_id, rn, ctp::BIGINT AS ctp, round(recall, 9) AS recall, round(precision, 9) AS precision FROM c")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d).select("grp", "event_id", F.col("rn").cast("bigint").alias("rn"), "ctp", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@_add("q_pr_curve_ap", f"""WITH {_SCORED}, e AS (SELECT *, max(precision) OVER (PARTITION BY grp ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, recall - coalesce(lag(recall) OVER (PARTITION BY grp ORDER BY rn), 0) AS gain FROM c)
SELECT grp, round(sum(gain*env), 6) AS ap, round(max(recall), 9) AS max_recall, count(*) AS detections FROM e GROUP BY ALL""")
def pr_curve_ap(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.average_precision(_curve(spark, d), ["grp"]).select("grp", F.round("ap", 6).alias("ap"), F.round("max_recall", 9).alias("max_recall"), "detections")


_OBJ = "o AS (SELECT p_partkey AS id, p_partkey % 3 AS cls, (p_partkey * 37) % 90 AS height_px, (p_partkey % 4)::INT AS occlusion, (p_partkey % 11) / 20.0::DOUBLE AS truncation, p_partkey % 5 > 0 AS hit FROM part), t(difficulty, h, oc, tr) AS (VALUES ('easy', 40, 0, 0.15), ('moderate', 25, 1, 0.30), ('hard', 25, 2, 0.50)), od AS (SELECT o.*, difficulty FROM o, t WHERE height_px >= h AND occlusion <= oc AND truncation <= tr)"


def _objects(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "part")
    k = F.col("p_partkey")
    return evaluate.difficulties(p.select(k.alias("id"), (k % 3).alias("cls"), (k * 37 % 90).alias("height_px"), (k % 4).cast("int").alias("occlusion"), (k % 11 / F.lit(20.0)).alias("truncation"), (k % 5 > 0).alias("hit")))


@_add("q_difficulty", f"WITH {_OBJ} SELECT id, difficulty FROM od")
def difficulty(spark: SparkSession, d: str) -> DataFrame:
    return _objects(spark, d).select("id", "difficulty")


@_add("q_cluster_recall", f"WITH {_OBJ} SELECT cls, difficulty, id % 4 AS band, count(*) AS n, count(*) FILTER (hit) AS found FROM od GROUP BY GROUPING SETS ((cls, difficulty), (cls, id % 4), (cls))")
def cluster_recall(spark: SparkSession, d: str) -> DataFrame:
    o = _objects(spark, d).withColumn("band", F.col("id") % 4)
    return o.groupingSets([["cls", "difficulty"], ["cls", "band"], ["cls"]], "cls", "difficulty", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("found"))


@_add("q_class_weights", "WITH c AS (SELECT event_type AS cls, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, n/sum(n) OVER () AS share FROM c) SELECT cls, n, round(share, 9) AS share, round(least(greatest(pow(share, -0.5)/sum(pow(share, -0.5)*share) OVER (), 0.125), 8.0), 6) AS weight FROM s")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "events").groupBy(F.col("event_type").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return evaluate.class_weights(c).select("cls", "n", F.round("share", 9).alias("share"), F.round("weight", 6).alias("weight"))


@_add("q_block_split", "WITH f AS (SELECT DISTINCT user_id AS frame FROM events), b AS (SELECT frame, ntile(20) OVER (ORDER BY frame) AS block FROM f) SELECT frame, block::INT AS block, CASE WHEN block <= 2 THEN 'val' WHEN block <= 4 THEN 'test' ELSE 'train' END AS split FROM b")
def block_split(spark: SparkSession, d: str) -> DataFrame:
    return cluster.split_blocks(fx.table(spark, d, "events").select(F.col("user_id").alias("frame")))


@_add("q_stride_sample", "WITH f AS (SELECT user_id AS frame, row_number() OVER (ORDER BY user_id) AS r FROM (SELECT DISTINCT user_id FROM events)) SELECT e.user_id AS frame, count(*) AS n FROM events e JOIN f ON f.frame = e.user_id AND (r-1) % 7 = 0 GROUP BY ALL")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return sinks.strided(fx.table(spark, d, "events").select(F.col("user_id").alias("frame")), 7).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@_add("q_occlusion", f"""WITH {_E3}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (x-1)*(x-1)+y*y+z*z, id) AS k, count(*) OVER (PARTITION BY label) AS n FROM e) SELECT id, label FROM r WHERE k <= greatest(cast(floor(n*0.5) as int), 8)""")
def occlusion(spark: SparkSession, d: str) -> DataFrame:
    dist = (F.col("x") - 1) * (F.col("x") - 1) + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    return cluster.rank_nearest(_embedded(spark, d), ["label"], dist, ["id"]).select("id", "label")


@_add("q_suggest_params", f"WITH {PTS}, n AS (SELECT frame, count(*) AS n FROM points GROUP BY ALL) SELECT frame, greatest(6, round_even(20*(n/121000.0::DOUBLE), 0)::INT) AS min_points, greatest(64, pow(2.0, round_even(log2(greatest(256*(n/121000.0::DOUBLE), 64.0)), 0))::INT) AS n_sample, round(greatest(0.30, least(0.80, 0.30/sqrt(greatest(n/121000.0::DOUBLE, 0.05)))), 6)::DOUBLE AS voxel FROM n")
def suggest_params(spark: SparkSession, d: str) -> DataFrame:
    n = fx.points(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    s = geo.suggested(F.col("n"))
    return n.select("frame", s["min_points"].alias("min_points"), s["n_sample"].alias("n_sample"), F.round(s["voxel"], 6).alias("voxel"))


def _clustered(spark: SparkSession, d: str, ids: tuple[str, ...] = ()) -> DataFrame:
    """(frame, ids, x, y, z, cluster_id) of what is not ground; written once, as it is read more than once."""
    above = sectors.ground_points(fx.points(spark, d).drop("lab"), ("frame",)).where("NOT ground")
    return cluster.cluster_points(written(above.select("frame", *ids, "x", "y", "z"), "above"), ["frame"], voxel=0.35, least=8)


@_add("q_cluster")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clustered(spark, d).groupBy("frame", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@_add("q_cluster_sample")
def cluster_sample(spark: SparkSession, d: str) -> DataFrame:
    ids = ("ok", "pk", "sk", "ln")
    s = cluster.sample(_clustered(spark, d, ids).where("cluster_id IS NOT NULL"), ["frame", "cluster_id"], list(ids))
    return s.groupBy("frame", "cluster_id").agg(F.count(F.lit(1)).alias("slots"), F.countDistinct("ok", "pk", "sk", "ln").alias("points"))


@_add("q_detect")
def detect(spark: SparkSession, d: str) -> DataFrame:
    """Clusters to boxes to classes, with the stand-in classifier."""
    c = _clustered(spark, d).where("cluster_id IS NOT NULL")
    boxes = quality.actors(c, ["frame", "cluster_id"], 20, 0.0)
    return cluster.classify(boxes.select("frame", "cluster_id", "n", F.col("mx").alias("cx"), F.col("my").alias("cy"), "cz", "l", "w", "h", "yaw"), least=0.0)


@_add("q_iou")
def iou(spark: SparkSession, d: str) -> DataFrame:
    a = fx.boxes(spark, d).select("frame", "id", *[F.col(c).alias(f"a_{c}") for c in evaluate.BOX])
    b = fx.detections(spark, d).select("id", "score", *[F.col(c).alias(f"b_{c}") for c in evaluate.BOX])
    return evaluate.with_iou(a.join(b, "id")).select("frame", "id", "score", "iou")


@_add("q_nms")
def nms(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.nms(fx.detections(spark, d), ["frame", "cls"], 0.1)


@_add("q_match")
def match(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.match(fx.detections(spark, d), fx.boxes(spark, d), ["frame", "cls"], 0.3)


#: Detections and boxes without headings, whose overlap SQL can tell, in lists by group.
_LEVEL = """d AS (SELECT id, frame, cls, cx + (id % 5 - 2)/8.0::DOUBLE AS cx, cy + (id % 3 - 1)/4.0::DOUBLE AS cy, cz, l, w, h, (cast(floor(part.p_retailprice*100) as bigint) * 7919 % 1000) / 1000.0::DOUBLE AS score FROM boxes JOIN part ON p_partkey = id WHERE id % 7 <> 0)"""
_OVER = "greatest(least({a}.cx+{a}.l/2, {b}.cx+{b}.l/2) - greatest({a}.cx-{a}.l/2, {b}.cx-{b}.l/2), 0) * greatest(least({a}.cy+{a}.w/2, {b}.cy+{b}.w/2) - greatest({a}.cy-{a}.w/2, {b}.cy-{b}.w/2), 0) * greatest(least({a}.cz+{a}.h/2, {b}.cz+{b}.h/2) - greatest({a}.cz-{a}.h/2, {b}.cz-{b}.h/2), 0)"
_IOU = f"{_OVER} / ({{a}}.l*{{a}}.w*{{a}}.h + {{b}}.l*{{b}}.w*{{b}}.h - {_OVER})"


def _level(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fx.detections(spark, d).withColumn("yaw", F.lit(0.0)), fx.boxes(spark, d).withColumn("yaw", F.lit(0.0))


@_add("q_nms_level", f"""WITH {fx.boxes_sql()}, {_LEVEL}, g AS (SELECT frame, list([d] ORDER BY score DESC, id) AS bs FROM d GROUP BY ALL),
r AS (SELECT list_reduce(bs, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: {_IOU.format(a='k', b='x[1]')} >= 0.05)) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM g), u AS (SELECT unnest(kept) AS k FROM r) SELECT k.frame AS frame, k.id AS id, k.score AS score FROM u""")
def nms_level(spark: SparkSession, d: str) -> DataFrame:
    """Suppression of boxes without headings, of all classes of a sweep."""
    return evaluate.nms(_level(spark, d)[0], ["frame"], 0.05).select("frame", "id", "score")


@_add("q_match_level", f"""WITH {fx.boxes_sql()}, {_LEVEL}, p AS (SELECT d.frame, d.id, d.score, b.id AS gt_id, {_IOU.format(a='d', b='b')} AS iou FROM d JOIN boxes b USING (frame)),
c AS (SELECT frame, id, any_value(score) AS score, list({{'gt': gt_id, 'iou': iou}} ORDER BY iou DESC, gt_id) AS cands FROM p WHERE iou >= 0.05 GROUP BY ALL),
g AS (SELECT frame, list([{{'id': id, 'gt': 0::BIGINT, 'iou': 0::DOUBLE, 'cands': cands}}] ORDER BY score DESC, id) AS ds FROM c GROUP BY ALL),
r AS (SELECT frame, list_reduce(ds, lambda taken, x: list_concat(taken, list_transform(list_filter(x[1].cands, lambda k: NOT list_contains(list_transform(taken, lambda t: t.gt), k.gt))[1:1], lambda k: {{'id': x[1].id, 'gt': k.gt, 'iou': k.iou, 'cands': x[1].cands}})), [{{'id': -1::BIGINT, 'gt': -1::BIGINT, 'iou': 0::DOUBLE, 'cands': ds[1][1].cands}}]) AS taken FROM g),
u AS (SELECT frame, unnest(taken) AS t FROM r) SELECT d.frame, d.id, d.score, u.t.gt IS NOT NULL AS tp, u.t.gt AS gt_id, round(u.t.iou, 6) AS iou FROM d LEFT JOIN u ON u.frame = d.frame AND u.t.id = d.id""")
def match_level(spark: SparkSession, d: str) -> DataFrame:
    """Matching of boxes without headings, of all classes of a sweep."""
    return evaluate.match(*_level(spark, d), ["frame"], 0.05).select("frame", "id", "score", "tp", "gt_id", F.round("iou", 6).alias("iou"))


@_add("q_cluster_cloud", f"""WITH RECURSIVE {PTS}, v AS (SELECT DISTINCT cast(floor(x/0.25::DOUBLE) as bigint) AS vx, cast(floor(y/0.25::DOUBLE) as bigint) AS vy, cast(floor(z/0.25::DOUBLE) as bigint) AS vz FROM points WHERE lab = 6),
near AS MATERIALIZED (SELECT a.vx, a.vy, a.vz, b.vx AS ux, b.vy AS uy, b.vz AS uz FROM v a, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dz) JOIN v b ON b.vx = a.vx + dx AND b.vy = a.vy + dy AND b.vz = a.vz + dz),
seen AS (SELECT vx, vy, vz, vx AS lx, vy AS ly, vz AS lz FROM v UNION SELECT n.ux, n.uy, n.uz, s.lx, s.ly, s.lz FROM seen s JOIN near n USING (vx, vy, vz) WHERE (n.ux, n.uy, n.uz) > (s.lx, s.ly, s.lz))
SELECT vx, vy, vz, min({{'x': lx, 'y': ly, 'z': lz}}).x AS lx, min({{'x': lx, 'y': ly, 'z': lz}}).y AS ly, min({{'x': lx, 'y': ly, 'z': lz}}).z AS lz FROM seen GROUP BY ALL""")
def cluster_cloud(spark: SparkSession, d: str) -> DataFrame:
    """Voxels of walkers of all sweeps in one cloud, by components across tiles of four metres."""
    p = fx.points(spark, d).where("lab = 6").select(*[F.floor(F.col(c) / F.lit(0.25)).alias(f"v{c}") for c in "xyz"])
    return tiles.connected(p, [], 16)


@_add("q_detection_ap")
def detection_ap(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of matched detections by class."""
    n = fx.boxes(spark, d).groupBy("cls").agg(F.count(F.lit(1)).alias("n_gt"))
    return evaluate.average_precision(evaluate.pr_curve(match(spark, d).join(n, "cls"), ["cls"], "id"), ["cls"])


@_add("q_proposals")
def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Clusters labelled by the share of their points in boxes."""
    c = _clustered(spark, d).where("cluster_id IS NOT NULL")
    size = c.groupBy("frame", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    boxes = fx.boxes(spark, d).withColumns({"l": F.col("l") * 4, "w": F.col("w") * 4, "ignored": F.col("id") % 9 == 0})
    # of equal boxes that agree in being ignored, the one with the smallest id wins whatever the points
    boxes = boxes.join(evaluate.different(boxes, ["frame", "ignored"]).select("frame", "id"), ["frame", "id"], "left_semi")
    hit = evaluate.points_in_boxes(c, boxes, ["frame"], 0.1).groupBy("frame", "cluster_id", F.col("id").alias("gt"), "cls", "ignored").agg(F.count(F.lit(1)).alias("k"))
    shares = size.join(hit, ["frame", "cluster_id"], "left").select("frame", "cluster_id", F.coalesce("gt", F.lit(-1)).alias("gt"), F.coalesce("cls", F.lit(0)).alias("cls"), F.coalesce(F.col("k") / F.col("n"), F.lit(0.0)).alias("frac"), F.coalesce("ignored", F.lit(False)).alias("ignored"))
    return cluster.proposal_labels(shares, ["frame", "cluster_id"])
