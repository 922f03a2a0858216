"""Dimension labels: their lines, the scales they say, and checks of scales against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.functions import geom, parse

from .segments import robust_median


def valued(labels: DataFrame) -> DataFrame:
    """Labels with value (metres) and unit; those without a value are left out."""
    return labels.withColumns({"value": parse.label_value(F.col("text")), "unit": parse.label_unit(F.col("text"))}).where("value is not null")


def text_boxes(texts: DataFrame, font: str = "font", x: str = "x", y: str = "y") -> DataFrame:
    """Estimated boxes of texts at a baseline: bx, by, bw, bh and the centre cx, cy. A missing font size is 10."""
    f = F.coalesce(F.col(font), F.lit(10.0))
    t = texts.withColumns({"bx": F.col(x), "by": F.col(y) - f, "bw": F.length("text") * f * 0.6, "bh": f * 1.2})
    return t.withColumns({"cx": F.col("bx") + F.col("bw") / 2, "cy": F.col("by") + F.col("bh") / 2})


def dimension_lines(feat: DataFrame, *, rel: float = 0.07, least: float = 50.0, diag: float | Column = 1280.0) -> DataFrame:
    """Lines that may carry a dimension: long and along an axis, with ``orientation`` h or v."""
    d = feat.withColumn("orientation", geom.loose_orientation(geom.seg()))
    bound = F.greatest((F.lit(diag) if not isinstance(diag, Column) else diag) * rel, F.lit(least))
    return d.where((F.col("len") >= bound) & (F.col("orientation") != "diag"))


def label_pairs(lines: DataFrame, labels: DataFrame, *, max_normal: float, cell: float | None = None) -> DataFrame:
    """For each line and each side of it the nearest label by normal distance, each label once a line: doc_id, seg_id,
    txt_id, side_of, dist, along, value, orientation, ratio (length along the axis over the value).

    Near-axis lines are bands: a label can be near only if its coordinate across the axis lies within the line's own span
    widened by the bound, continued as far as the page goes. Bands of the coordinate across the axis are the join's keys."""
    step = cell or max(4 * max_normal, 1.0)
    h = F.col("orientation") == "h"
    s = geom.seg()
    # A line a few degrees off its axis drifts across it; the page's extent times its slope bounds by how much.
    far = labels.groupBy("doc_id").agg(F.min("cx").alias("lx0"), F.max("cx").alias("lx1"), F.min("cy").alias("ly0"), F.max("cy").alias("ly1"))
    ln = lines.join(far, "doc_id")
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    at = lambda u: F.when(h, s.y1 + dy / dx * (u - s.x1)).otherwise(s.x1 + dx / dy * (u - s.y1))
    a, b = at(F.when(h, F.col("lx0")).otherwise(F.col("ly0"))), at(F.when(h, F.col("lx1")).otherwise(F.col("ly1")))
    slack = max_normal * 1.1  # the normal distance is shorter than that across the axis, by the cosine of ten degrees at most
    band = F.explode(F.sequence(F.floor((F.least(a, b) - slack) / step), F.floor((F.greatest(a, b) + slack) / step)))
    ln = ln.select("doc_id", "seg_id", "orientation", "len", "x1", "y1", "x2", "y2", band.alias("_band"))
    both = F.explode(F.array(F.struct(F.lit("h").alias("orientation"), F.floor(F.col("cy") / step).alias("_band")), F.struct(F.lit("v").alias("orientation"), F.floor(F.col("cx") / step).alias("_band")))).alias("k")
    tx = labels.select("doc_id", "txt_id", "value", "cx", "cy", both).select("doc_id", "txt_id", "value", "cx", "cy", "k.*")
    along, across = geom.along_and_across(F.col("cx"), F.col("cy"), geom.seg())
    p = ln.join(tx, ["doc_id", "orientation", "_band"]).withColumns({"along": along, "across": across}).where(F.abs("across") <= max_normal)
    p = p.withColumns({"dist": F.abs("across"), "side_of": F.when(F.col("across") >= 0, 1).otherwise(-1)})
    w = Window.partitionBy("doc_id", "seg_id", "side_of").orderBy("dist", "txt_id")
    p = p.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    span = F.when(F.col("orientation") == "h", F.abs(F.col("x2") - F.col("x1"))).otherwise(F.abs(F.col("y2") - F.col("y1")))
    return p.select("doc_id", "seg_id", "txt_id", "side_of", "dist", "along", "value", "orientation", (span / F.col("value")).alias("ratio"))


def gated(pairs: DataFrame, expected: float | None, within: float = 0.5) -> DataFrame:
    """Pairs whose ratio is within a share of the expected scale; all of a document that would keep none."""
    if expected is None:
        return pairs
    ok = F.abs(F.col("ratio") - expected) <= within * abs(expected)
    n = pairs.groupBy("doc_id").agg(F.count_if(ok).alias("_ok"))
    return pairs.join(n, "doc_id").where(ok | (F.col("_ok") == 0)).drop("_ok")


def dimension_scale(pairs: DataFrame, *, tol: float = 0.05, least: int = 3) -> DataFrame:
    """Robust scale of each document by orientation: doc_id, orientation, n, inliers, scale."""
    return robust_median(pairs, "ratio", "doc_id", "orientation", tol=tol, least=least)


def metric_scale(scales: DataFrame, models: DataFrame, *, pixels_per_unit: float, unit: str = "m") -> DataFrame:
    """Pixels of each metre by the label scales next to the page scale's: doc_id, dim_x, dim_y, model_scale, percent gap
    and a note where they differ by more than 5 %, or where the two axes differ by more than 2 %."""
    metre = parse.unit_metres(F.lit(unit))
    wide = scales.groupBy("doc_id").pivot("orientation", ["h", "v"]).agg(F.first("scale"))
    m = models.select("doc_id", ((F.col("sx") + F.col("sy")) / 2 * pixels_per_unit / metre).alias("model_scale"), (F.abs(F.col("sx") / F.col("sy") - 1) > 0.02).alias("uneven"))
    j = m.join(wide, "doc_id", "left").select("doc_id", F.col("h").alias("dim_x"), F.col("v").alias("dim_y"), "model_scale", "uneven")
    mean = F.when(F.col("dim_x").isNotNull() & F.col("dim_y").isNotNull(), (F.col("dim_x") + F.col("dim_y")) / 2).otherwise(F.coalesce("dim_x", "dim_y"))
    j = j.withColumn("gap", geom.percent_gap(mean, F.col("model_scale")))
    note = F.concat_ws("; ", F.when(F.col("gap") > 5, "scales differ"), F.when(F.col("uneven"), "axes differ"), F.when(mean.isNull(), "no labels"))
    return j.withColumn("notes", note)


def text_summary(texts: DataFrame, examples: int = 5) -> DataFrame:
    """For each document: how many texts there are, with a value and with a unit, and the first few as they are."""
    t = texts.withColumn("_v", parse.label_value(F.col("text")))
    first = F.slice(F.array_sort(F.collect_list(F.struct("txt_id", "text"))), 1, examples)
    w = Window.partitionBy("doc_id").orderBy("txt_id")
    few = t.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= examples).groupBy("doc_id").agg(first.alias("_few"))
    n = t.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("_v").alias("with_value"), F.count_if(parse.loose_unit(F.col("text")).isNotNull()).alias("with_unit"))
    return n.join(few, "doc_id").select("doc_id", "n", "with_value", "with_unit", F.transform("_few", lambda x: x["text"]).alias("examples"))


def pixels_per_unit(settings: Column) -> Column:
    """Pixels of a unit from a map of settings: the first of these that is a positive number: pixels_per_unit, then the mean
    of scale_x and scale_y, then the mean column norm of the matrix a, b, c, d."""
    at = lambda k: F.try_element_at(settings, F.lit(k)).try_cast("double")
    mean = mean_finite(at("scale_x"), at("scale_y"))
    matrix = (geom.norm(at("a"), at("b")) + geom.norm(at("c"), at("d"))) / 2
    positive = lambda v: F.when(v > 0, v)
    return F.coalesce(positive(at("pixels_per_unit")), positive(mean), positive(matrix))


def mean_finite(*values: Column) -> Column:
    """Mean of those that are numbers and finite; null if none is."""
    ok = F.filter(F.array(*values), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda a, v: a + v) / F.size(ok))
