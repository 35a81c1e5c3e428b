"""Labels of points and boxes: gates, class tables, pixels, subsamples, provenance, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepgrid.operators import cluster, evaluate, quality
from sweepgrid.operators.sectors import ground_points
from sweepgrid.sources.workspace import written

#: Classes of the grid, in order.
GRID = ("ground", "road", "building", "pole", "vegetation", "car", "pedestrian", "other")
#: Grid class of each class that a detector may name (fixed values).
TO_GRID = {"Background": "other", "Car": "car", "Van": "car", "Truck": "car", "Pedestrian": "pedestrian", "Cyclist": "pedestrian", "Pole": "pole", "TrafficLight": "pole"}
#: Labelled but never a training target (fixed values).
IGNORED = ("Person_sitting", "Tram", "Misc", "DontCare")
#: Display classes of terrain come before those of detections.
TERRAIN = 3
GATE_POINTS, GATE_REST = 500, 50


def class_table(spark, names: list[str]) -> DataFrame:
    """(cls, name, grid, provenance) of a detector's classes; a name without a grid class is an error."""
    unknown = [n for n in names if n not in TO_GRID]
    if unknown:
        raise KeyError(f"no grid class for {unknown}")
    rows = [(k, n, GRID.index(TO_GRID[n]), n.lower()) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "cls INT, name STRING, grid INT, provenance STRING")


def checked(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Rows with the columns of a class table (cls, grid, provenance); a class that it lacks is an error."""
    out = rows.join(F.broadcast(table.select(F.col("cls").alias("__c"), "grid", "provenance")), F.col(column) == F.col("__c"), "left")  # a row a class
    bad = F.col(column).isNotNull() & F.col("__c").isNull()
    return out.withColumn("grid", F.when(bad, F.raise_error(F.concat(F.lit("no grid class for class "), F.col(column).cast("string")))).otherwise(F.col("grid"))).drop("__c")


def display_to_grid(display: str, ground: str, detected: dict[int, int], offset: int = TERRAIN) -> Column:
    """Grid class of a display class: detections first, then terrain and ground as road, else other."""
    out = F.when(F.col(ground) | F.col(display).between(0, offset - 1), GRID.index("road")).otherwise(GRID.index("other"))
    for code, grid in detected.items():
        out = F.when(F.col(display) == offset + code, grid).otherwise(out)
    return out


def frame_gates(points: DataFrame, keys: list[str], ground: Column, least: int = GATE_POINTS, least_rest: int = GATE_REST) -> DataFrame:
    """Points of the frames with enough of them, and enough that are not ground."""
    good = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ground).alias("rest")).where((F.col("n") >= least) & (F.col("rest") >= least_rest))
    return points.join(good.select(*keys), keys, "left_semi")


def without_ignored(labels: DataFrame, column: str = "type", ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Labelled objects that may be targets."""
    return labels.where(~F.col(column).isin(*ignored))


def pixel_labels(points: DataFrame, pixels: DataFrame, size: tuple[int, int] = (1242, 375), least: float = 0.5) -> DataFrame:
    """Points (frame, u, v, depth) with road of the pixel they fall on; only pixels that are valid."""
    p = points.withColumns({"__u": F.rint("u").cast("int"), "__v": F.rint("v").cast("int")})
    p = p.where((F.col("depth") > least) & F.col("__u").between(0, size[0] - 1) & F.col("__v").between(0, size[1] - 1))
    known = pixels.where("valid").select("frame", F.col("u").alias("__u"), F.col("v").alias("__v"), "road")
    return p.join(known, ["frame", "__u", "__v"]).drop("__u", "__v")


def display_subsample(points: DataFrame, keys: list[str], dynamic: Column, order: list[Column], budget: int) -> DataFrame:
    """All dynamic points of a frame, and of the others those that come first in ``order``, to ``budget`` in all."""
    p = points.withColumn("__d", dynamic)
    first = Window.partitionBy(*keys).orderBy(F.desc("__d"), *order)
    return p.withColumn("__r", F.row_number().over(first)).where(F.col("__d") | (F.col("__r") <= budget)).drop("__d", "__r")


def strided_points(points: DataFrame, keys: list[str], order: list[str], most: int = 12_000) -> DataFrame:
    """Every k-th point of a frame in order, k being as many times as the frame holds ``most`` points."""
    w = Window.partitionBy(*keys)
    step = F.greatest(F.expr(f"__n div {most}"), F.lit(1))
    p = points.withColumns({"__r": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    return p.where(F.col("__r") % step == 0).drop("__r", "__n")


def commonest(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(column, rows, share): the ``n`` values that occur most, the smaller first on ties."""
    c = rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = c.agg(F.sum("rows").alias("total"))
    top = c.orderBy(F.desc("rows"), column).limit(n)
    return top.join(F.broadcast(total)).select(column, "rows", (F.col("rows") / F.col("total")).alias("share"))  # one row


def closest(pairs: DataFrame, order: str, ids: list[str], n: int) -> DataFrame:
    """The ``n`` pairs of the greatest ``order``."""
    return pairs.orderBy(F.desc(order), *ids).limit(n)


def best_pairs(truth: DataFrame, detections: DataFrame, keys: list[str], bucket: float = 8.0) -> DataFrame:
    """(keys, gt_id, gt_cls, id, cls, score, iou): for every true box the detection that overlaps it most; null if none does.

    Only different boxes meet: of equal detections the one with the smallest id stands for all, and equal true boxes have
    the same best one. Overlaps that agree to nine digits are ties, which go to the smaller id.
    """
    first = F.min(F.struct(F.col("id").alias("i"), "cls", "score")).alias("f")
    found = detections.groupBy(*keys, *evaluate.BOX).agg(first).select(*keys, *evaluate.BOX, F.col("f.i").alias("id"), "f.cls", "f.score")
    named = {f"t_{c}": F.col(f"a_{c}") for c in evaluate.BOX} | {c: F.col(f"b_{c}") for c in ("id", "cls", "score")}
    met = evaluate.overlaps(truth.select(*keys, *evaluate.BOX).distinct(), found, keys, named, bucket).where("iou > 0")
    best = met.groupBy(*keys, *[F.col(f"t_{c}").alias(c) for c in evaluate.BOX]).agg(F.max(F.struct(F.round("iou", 9).alias("near"), (-F.col("id")).alias("k"), "cls", "score", "iou")).alias("b"))
    t = truth.select(*keys, F.col("id").alias("gt_id"), F.col("cls").alias("gt_cls"), *evaluate.BOX)
    return t.join(best, [*keys, *evaluate.BOX], "left").select(*keys, "gt_id", "gt_cls", (-F.col("b.k")).alias("id"), "b.cls", "b.score", F.coalesce("b.iou", F.lit(0.0)).alias("iou"))


def diagnosis(pairs: DataFrame, levels: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7)) -> DataFrame:
    """(gt_cls, n, missed, mislabelled, median_iou, p90_iou, at_…): what becomes of the true boxes of each class."""
    same = F.col("cls") == F.col("gt_cls")
    return pairs.groupBy("gt_cls").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cls").isNull()).alias("missed"), F.count_if(~same).alias("mislabelled"), F.median("iou").alias("median_iou"), F.percentile("iou", F.lit(0.9)).alias("p90_iou"),
        *[F.avg((F.col("iou") >= v).cast("int")).alias(f"at_{int(100 * v)}") for v in levels],
    )


def detection_report(conf: DataFrame, classes: DataFrame, background: str | int) -> DataFrame:
    """(mean_f1, fg_recall, classes): over all foreground classes of ``classes`` (cls), also those without a row."""
    of = classes.where(F.col("cls") != background).select("cls").join(evaluate.precision_recall(conf), "cls", "left")
    return of.agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("mean_f1"), (F.sum(F.coalesce("tp", F.lit(0))) / F.greatest(F.sum(F.coalesce("support", F.lit(0))), F.lit(1))).alias("fg_recall"), F.count(F.lit(1)).alias("classes"))


def box_errors(matched: DataFrame) -> DataFrame:
    """(cls, n, centre, size, yaw_deg): mean errors of matched boxes (prefixes a_ for truth, b_ for found)."""
    from sweepgrid.functions.geometry import wrap

    norm = lambda names: F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in names), F.lit(0.0)))
    size = sum((F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "lwh"), F.lit(0.0)) / 3
    return matched.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.avg(norm(("cx", "cy", "cz"))).alias("centre"), F.avg(size).alias("size"), F.avg(F.degrees(F.abs(wrap(F.col("a_yaw") - F.col("b_yaw"))))).alias("yaw_deg"))


def detected(marked: DataFrame, keys: list[str], model: cluster.Classifier = cluster.geometric_classifier, voxel: float = cluster.VOXEL, least: int = cluster.MIN_POINTS, most: int = cluster.MAX_POINTS) -> tuple[DataFrame, DataFrame]:
    """Points that are not ground with their cluster_id, and a box with a class for each cluster; both are written."""
    rest = written(cluster.cluster_points(marked.where("NOT ground"), keys, voxel, least, most), "clusters")
    boxes = quality.actors(rest.where("cluster_id IS NOT NULL"), [*keys, "cluster_id"], 1, 0.0).select(*keys, "cluster_id", F.col("mx").alias("cx"), F.col("my").alias("cy"), "cz", "l", "w", "h", "yaw")
    return rest, written(cluster.classify(boxes, model, least=0.0), "boxes")


def labelled(marked: DataFrame, rest: DataFrame, boxes: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """Ground and other points with cluster_id, grid and provenance."""
    named = boxes.select(*keys, "cluster_id", F.col("cls").alias("__cls"))
    rest = rest.join(named, [*keys, "cluster_id"], "left")
    rest = checked(rest.withColumn("__cls", F.when(F.col("cluster_id").isNotNull(), F.coalesce("__cls", F.lit(0)))), table, "__cls").drop("__cls")
    rest = rest.withColumns({"grid": F.coalesce("grid", F.lit(GRID.index("other"))), "provenance": F.coalesce("provenance", F.lit("unclustered"))})
    ground = marked.where("ground").withColumns({"cluster_id": F.lit(None).cast("bigint"), "grid": F.lit(GRID.index("ground")), "provenance": F.lit("ground")})
    columns = [*marked.columns, "cluster_id", "grid", "provenance"]
    return ground.select(*columns).unionByName(rest.select(*columns))


def label_points(points: DataFrame, keys: list[str], table: DataFrame, model: cluster.Classifier = cluster.geometric_classifier, voxel: float = cluster.VOXEL, least: int = cluster.MIN_POINTS, most: int = cluster.MAX_POINTS) -> DataFrame:
    """Points (keys, x, y, z, …) with agl, ground, cluster_id, grid and provenance, end to end.

    Ground planes by sector, clusters of the rest, a class for each cluster, and the class's grid code.
    Ground points are ground; points of no cluster are ``unclustered`` and other; a cluster that the
    model takes for nothing is ``background``. ``table`` is a class table whose class 0 is background.
    """
    marked = written(ground_points(points, tuple(keys)).drop("ri", "ai"), "ground")
    return labelled(marked, *detected(marked, keys, model, voxel, least, most), keys, table)
