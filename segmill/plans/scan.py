"""Drawings read as a whole: segments that are fitted, snapped and merged, and the scales that their labels say."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.durable import materialize
from segmill.operators import labels, segments
from segmill.sources import svg


def drawings(docs: DataFrame, *, tol: float = 0.25, relative: float | None = None, axis_tol: float = 2.0, max_spread: float = 3.0, max_off: float = 1.0, merge: Mapping[str, Any] | None = None) -> DataFrame:
    """Segments of drawings (doc_id, svg) with their features: polylines that are nearly straight as one fitted segment,
    others as their edges, near-axis ones snapped, collinear ones merged if ``merge`` has off_tol and gap_max. Ids follow from
    the places in the drawing, those of merged ones from the segments."""
    points = svg.polylines(docs, tol=tol, relative=relative)
    s = segments.straight(points, "doc_id", "poly_id", max_spread=max_spread, max_off=max_off)
    s = s.select("doc_id", F.lit("svg").alias("side"), (F.col("poly_id").cast("long") * (1 << 31) + F.col("part") + 1).alias("seg_id"), "x1", "y1", "x2", "y2")
    # Written, as each step below names the ends of the one before many times, which would grow beyond what can be compiled.
    s = materialize(segments.snap(segments.features(materialize(s, "fitted"), axis_tol), axis_tol), "snapped")
    if merge:
        s = segments.merge_collinear(segments.features(s.select("doc_id", "side", "seg_id", "x1", "y1", "x2", "y2"), axis_tol), off_tol=merge["off_tol"], gap_max=merge["gap_max"])
        s = materialize(s.withColumn("seg_id", F.xxhash64("x1", "y1", "x2", "y2")), "merged")
    return segments.features(s.select("doc_id", "side", "seg_id", "x1", "y1", "x2", "y2"), axis_tol)


def dimensions(docs: DataFrame, *, max_normal: float = 40.0, tol: float = 0.05, least: int = 3, expected: float | None = None, diag: float | Column | None = None) -> DataFrame:
    """Scales that drawings (doc_id, svg) say of themselves, by orientation: doc_id, orientation, n, inliers, scale. Lines that
    may carry a dimension meet the text elements next to them; ratios far from an ``expected`` scale don't count, unless a
    drawing has no other. Lines count from 7 % of ``diag`` on, by default the drawing's own diagonal."""
    lines = segments.features(svg.dimension_segments(docs))
    if diag is None:
        size = segments.bbox(lines, "doc_id").select("doc_id", F.col("diag").alias("_diag"))
        lines, diag = lines.join(size, "doc_id"), F.col("_diag")
    texts = labels.valued(labels.text_boxes(svg.texts(docs)))
    pairs = labels.label_pairs(labels.dimension_lines(lines, diag=diag), texts, max_normal=max_normal)
    return labels.dimension_scale(labels.gated(pairs, expected), tol=tol, least=least)
