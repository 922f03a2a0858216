"""Rasters and labels together: orientation of the drawing's canvas, its scale, and what the labels say of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.functions import geom
from segmill.operators import labels, raster


def run(px: DataFrame, lines: DataFrame, texts: DataFrame, *, rows: int, cols: int, pixels_per_unit: float = 1.0, low: float = 0.92, high: float = 1.08, max_normal: float = 40.0, diag: float = 1280.0) -> DataFrame:
    """One row a document: rot, flip, shift and score of the canvas (doc_id, side, row, col, val), its best scale and NCC,
    the scales of the labels (``texts``) along the lines (``lines``, with features), their gap in percent, and notes."""
    o = raster.raster_orientation(px, rows, cols)
    s = raster.raster_scale(px, rows, cols, low=low, high=high)
    pairs = labels.label_pairs(labels.dimension_lines(lines, diag=diag), labels.valued(texts), max_normal=max_normal)
    d = labels.dimension_scale(pairs, tol=0.1).groupBy("doc_id").pivot("orientation", ["h", "v"]).agg(F.first("scale"))
    j = o.join(s, "doc_id").join(d, "doc_id", "left").withColumnsRenamed({"h": "dim_x", "v": "dim_y"})
    mean = labels.mean_finite(F.col("dim_x"), F.col("dim_y"))
    gap = geom.percent_gap(mean, F.col("scale") * pixels_per_unit)
    notes = F.concat_ws("; ", F.when(mean.isNull(), "no labels"), F.when(gap > 5, "label and page scale differ"), F.when(F.abs(F.col("dim_x") / F.col("dim_y") - 1) > 0.02, "axes differ"))
    return j.withColumn("gap", gap).withColumn("notes", notes)
