"""Filters, top-k, merging and statistics of segment tables (doc_id, side, seg_id, x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.functions import geom


def features(segs: DataFrame, tol: float = 2.0) -> DataFrame:
    """``segs`` with len, ang (0 to 180), cx, cy and axis (H, V or null)."""
    s = geom.seg()
    cx, cy = geom.center(s)
    return segs.withColumns({"len": geom.length(s), "ang": geom.angle180(s), "cx": cx, "cy": cy}).withColumn("axis", geom.axis(F.col("ang"), tol))


def bbox(segs: DataFrame, *keys: str) -> DataFrame:
    """Box and diagonal of each group."""
    g = segs.groupBy(*keys).agg(F.min(F.least("x1", "x2")).alias("min_x"), F.min(F.least("y1", "y2")).alias("min_y"), F.max(F.greatest("x1", "x2")).alias("max_x"), F.max(F.greatest("y1", "y2")).alias("max_y"))
    return g.withColumn("diag", geom.norm(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))


def axis_summary(feat: DataFrame, *keys: str) -> DataFrame:
    """Counts by axis, box, total length and length percentiles of each group."""
    n = lambda c: F.count_if(c).alias
    pct = lambda q, name: F.percentile("len", F.lit(q)).alias(name)
    return feat.groupBy(*keys).agg(
        F.count("*").alias("n"), n(F.col("axis") == "H")("n_h"), n(F.col("axis") == "V")("n_v"), n(F.col("axis").isNull())("n_other"),
        F.min(F.least("x1", "x2")).alias("min_x"), F.min(F.least("y1", "y2")).alias("min_y"), F.max(F.greatest("x1", "x2")).alias("max_x"), F.max(F.greatest("y1", "y2")).alias("max_y"),
        F.sum("len").alias("total"), F.min("len").alias("min_len"), pct(0.5, "p50_len"), pct(0.9, "p90_len"), F.max("len").alias("max_len"),
    )


def axes_present(feat: DataFrame, *keys: str) -> DataFrame:
    """Whether a group has segments of both axes, as a status and not as an error."""
    g = feat.groupBy(*keys).agg(F.count_if(F.col("axis") == "H").alias("n_h"), F.count_if(F.col("axis") == "V").alias("n_v"))
    return g.withColumn("status", F.when((g.n_h > 0) & (g.n_v > 0), "ok").when(g.n_h > 0, "no vertical").when(g.n_v > 0, "no horizontal").otherwise("no axis"))


def prefilter(feat: DataFrame, pages: DataFrame, min_rel: float, ref: str = "diagonal") -> DataFrame:
    """Segments of at least ``min_rel`` of the page's width, height or diagonal; all of a page that would keep none."""
    size = {"width": F.col("w"), "height": F.col("h"), "diagonal": geom.norm(F.col("w"), F.col("h"))}[ref]
    long_ = feat.join(pages.select("doc_id", "side", (size * min_rel).alias("_least")), ["doc_id", "side"]).withColumn("_long", F.col("len") >= F.col("_least"))
    kept = long_.groupBy("doc_id", "side").agg(F.count_if("_long").alias("_kept"))
    # The counts are joined back: a window over the page would sort all of its rows in one task.
    return long_.join(kept, ["doc_id", "side"]).where("_long or _kept = 0").drop("_long", "_least", "_kept")


def top_relative(feat: DataFrame, share: float, least: int) -> DataFrame:
    """The longest max(least, floor(n * share)) of each document and side; ties by seg_id."""
    n = feat.groupBy("doc_id", "side").agg(F.greatest(F.lit(least), F.floor(F.count("*") * share)).alias("_k"))
    w = Window.partitionBy("doc_id", "side").orderBy(F.desc("len"), "seg_id")
    return feat.join(n, ["doc_id", "side"]).withColumn("rank", F.row_number().over(w)).where("rank <= _k").drop("_k")


def top_absolute(feat: DataFrame, k: int, *by: str) -> DataFrame:
    """The ``k`` longest of each group; ties by seg_id. The bound is pushed before the shuffle by window-group limits."""
    w = Window.partitionBy(*(by or ("doc_id", "side"))).orderBy(F.desc("len"), "seg_id")
    return feat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def snap(feat: DataFrame, tol: float = 2.0) -> DataFrame:
    """Ends moved onto the axis that a segment nearly follows."""
    s = geom.snapped(geom.seg(), tol)
    return feat.withColumns({"x1": s.x1, "y1": s.y1, "x2": s.x2, "y2": s.y2})


def merge_collinear(feat: DataFrame, *, off_tol: float = 1.0, gap_max: float = 2.0) -> DataFrame:
    """Axis-following segments that lie in one bucket of offsets and follow each other within ``gap_max`` become one, at
    the mean offset weighted by length: doc_id, side, axis, x1, y1, x2, y2, n. Others stay as they are."""
    h = F.col("axis") == "H"
    lo, hi = F.when(h, F.least("x1", "x2")).otherwise(F.least("y1", "y2")), F.when(h, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2"))
    off = F.when(h, F.col("cy")).otherwise(F.col("cx"))
    s = feat.where("axis is not null").select("doc_id", "side", "axis", "seg_id", lo.alias("lo"), hi.alias("hi"), off.alias("off"), "len").withColumn("bucket", F.rint(F.col("off") / off_tol))
    w = Window.partitionBy("doc_id", "side", "axis", "bucket").orderBy("lo", "seg_id")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_new", F.when(reach.isNull() | (F.col("lo") - reach > gap_max), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    m = s.groupBy("doc_id", "side", "axis", "bucket", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("off") * F.col("len")).alias("m"), F.sum("len").alias("l"), F.avg("off").alias("plain"), F.count("*").alias("n"))
    at = F.when(F.col("l") > 0, F.col("m") / F.col("l")).otherwise(F.col("plain"))
    pick = lambda a, b: F.when(F.col("axis") == "H", a).otherwise(b)
    merged = m.select("doc_id", "side", "axis", pick(F.col("lo"), at).alias("x1"), pick(at, F.col("lo")).alias("y1"), pick(F.col("hi"), at).alias("x2"), pick(at, F.col("hi")).alias("y2"), "n")
    rest = feat.where("axis is null").select("doc_id", "side", "axis", "x1", "y1", "x2", "y2", F.lit(1).cast("long").alias("n"))
    return merged.unionByName(rest)


def line_fit(points: DataFrame, *keys: str) -> DataFrame:
    """Total least squares line through each group's points x, y: centroid, angle (0 to 180), ends of the projections,
    largest and root mean square distance. The direction is half the angle of the covariance's double-angle vector."""
    return _line_fit(points, *keys).drop("first", "last")


def _line_fit(points: DataFrame, *keys: str) -> DataFrame:
    """``line_fit`` with the points that are first and last along the line."""
    m = points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"))
    m = m.withColumn("theta", F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2)
    p = points.join(m, list(keys))
    ux, uy, dx, dy = F.cos("theta"), F.sin("theta"), F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    off = dx * uy - dy * ux
    t = dx * ux + dy * uy
    g = p.groupBy(*keys, "n", "mx", "my", "theta").agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.max(F.abs(off)).alias("max_off"), F.sqrt(F.avg(off * off)).alias("rms_off"), F.min_by(F.struct("x", "y"), t).alias("first"), F.max_by(F.struct("x", "y"), t).alias("last"))
    return g.withColumn("angle", F.pmod(F.degrees("theta"), F.lit(180.0)))


def edges(points: DataFrame, *keys: str, order: str = "i") -> DataFrame:
    """Edges x1, y1, x2, y2 between points that follow each other, without those of no length."""
    w = Window.partitionBy(*keys).orderBy(order)
    e = points.select(*keys, F.col(order), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return e.where("x2 is not null and not (x1 = x2 and y1 = y2)")


def angle_spread(edges_: DataFrame, *keys: str) -> DataFrame:
    """Smallest window on the circle of line directions that holds all edges' directions: 180 less the largest gap."""
    a = edges_.select(*keys, geom.angle180(geom.seg()).alias("a"))
    w = Window.partitionBy(*keys).orderBy("a")
    g = a.withColumn("gap", F.lead("a").over(w) - F.col("a")).groupBy(*keys).agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.max("gap").alias("gap"))
    return g.select(*keys, (180 - F.greatest(F.coalesce("gap", F.lit(0.0)), F.col("lo") + 180 - F.col("hi"))).alias("spread"))


def pair_spread(edges_: DataFrame, *keys: str, order: str = "i") -> DataFrame:
    """Largest angle (0 to 180) between the directed edges of each group of two or more. The edge that differs most from
    another is the one whose direction is nearest to the opposite of the other's, on the circle of directions."""
    s = geom.seg()
    d = edges_.select(*keys, F.pmod(F.degrees(F.atan2(s.y2 - s.y1, s.x2 - s.x1)), F.lit(360.0)).alias("a"))
    here = d.select(*keys, F.explode(F.array(F.col("a") - 360, F.col("a"), F.col("a") + 360)).alias("a"), F.lit(True).alias("own"))
    there = d.select(*keys, F.pmod(F.col("a") + 180, F.lit(360.0)).alias("a"), F.lit(False).alias("own"))
    w = Window.partitionBy(*keys).orderBy("a")
    own = F.when(F.col("own"), F.col("a"))
    below = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = here.unionByName(there).withColumn("gap", F.least(F.col("a") - below, above - F.col("a")))
    return near.where("not own").groupBy(*keys).agg(F.count("*").alias("n"), (180 - F.min("gap")).alias("spread")).where("n > 1").drop("n")


def straight(points: DataFrame, *keys: str, max_spread: float = 10.0, max_off: float = 1.0, order: str = "i") -> DataFrame:
    """Polylines as one fitted segment where all is nearly on a line, else as their edges: keys, part, x1, y1, x2, y2. Where
    all is on a line but for rounding, the segment has the polyline's own ends, which the fit would give with other last bits."""
    e = edges(points, *keys, order=order)
    good = _line_fit(points, *keys).join(angle_spread(e, *keys), list(keys)).where((F.col("spread") <= max_spread) & (F.col("max_off") <= max_off))
    at = lambda t: (F.col("mx") + t * F.cos("theta"), F.col("my") + t * F.sin("theta"))
    exact = F.col("max_off") <= 1e-12 * (1 + F.abs("mx") + F.abs("my") + F.col("hi") - F.col("lo"))
    (x1, y1), (x2, y2) = ([F.when(exact, F.col(f"{end}.{c}")).otherwise(v) for c, v in zip("xy", at(F.col(t)), strict=True)] for end, t in (("first", "lo"), ("last", "hi")))
    one = good.select(*keys, F.lit(-1).alias("part"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    rest = e.join(good.select(*keys), list(keys), "left_anti").select(*keys, F.col(order).cast("int").alias("part"), "x1", "y1", "x2", "y2")
    return one.unionByName(rest)


def rect_edges(df: DataFrame, *keys: str) -> DataFrame:
    """The four edges of rectangles x, y, w, h; rectangles without a width or height have none."""
    x, y, w, h = (F.col(c) for c in "xywh")
    side = lambda i, a, b, c, d: F.struct(F.lit(i).alias("part"), a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    four = F.array(side(0, x, y, x + w, y), side(1, x + w, y, x + w, y + h), side(2, x + w, y + h, x, y + h), side(3, x, y + h, x, y))
    return df.where("w > 0 and h > 0").select(*keys, F.explode(four).alias("e")).select(*keys, "e.*")


def sample_inside(feat: DataFrame, n: int = 16) -> DataFrame:
    """``n`` points within each segment: pt_id, px, py."""
    t = F.col("pt_id") / F.lit(float(n + 1))
    s = feat.withColumn("pt_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return s.withColumn("px", F.col("x1") + (F.col("x2") - F.col("x1")) * t).withColumn("py", F.col("y1") + (F.col("y2") - F.col("y1")) * t)


def sample_steps(feat: DataFrame, step: float, cap: int | None = None) -> DataFrame:
    """Points along each segment, ends included, no more than ``step`` apart: doc_id, seg_id, i, px, py; the first ``cap`` of
    a document in the order of seg_id, if a cap is the wish."""
    n = F.greatest(F.ceil(F.col("len") / step), F.lit(1)).cast("long")
    s = feat.withColumn("_n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    t = F.col("i") / F.col("_n")
    p = s.select("doc_id", "seg_id", "i", (F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("px"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("py"))
    if cap is not None:
        p = p.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg_id", "i"))).where(F.col("_k") <= cap).drop("_k")
    return p


def _closeness(sigma: float, hard: float) -> Column:
    return F.when(F.col("d") < hard, F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma))).otherwise(F.lit(0.0))


def chamfer(d: DataFrame, *keys: str, sigma: float, hard: float) -> DataFrame:
    """Chamfer score of capped distances ``d`` alone: score, n. It sums up before the shuffle, which percentiles can't."""
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(_closeness(sigma, hard)).alias("score"))


def residuals(d: DataFrame, *keys: str, sigma: float, hard: float) -> DataFrame:
    """Chamfer score and residual statistics of capped distances ``d``: score, rmse, p95, median, n."""
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(_closeness(sigma, hard)).alias("score"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.percentile("d", F.lit(0.95)).alias("p95"), F.percentile("d", F.lit(0.5)).alias("median"))


def robust_median(df: DataFrame, value: str, *keys: str, tol: float = 0.05, least: int = 3) -> DataFrame:
    """Median of what lies within ``tol`` (relative) of the median, where that is ``least`` values or more, else null."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"), F.count("*").alias("n"))
    near = df.join(first, list(keys)).where(F.abs(F.col(value) - F.col("_m")) <= tol * F.abs("_m"))
    got = near.groupBy(*keys).agg(F.count("*").alias("inliers"), F.percentile(value, F.lit(0.5)).alias("_r"))
    kept = F.coalesce("inliers", F.lit(0))
    return first.join(got, list(keys), "left").select(*keys, "n", kept.alias("inliers"), F.when(kept >= least, F.col("_r")).alias("scale"))


def quantile_spans(feat: DataFrame) -> DataFrame:
    """Scale of each document by axis: the spread of centres (95 % less 5 %) of one side over the other's."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    span = feat.groupBy("doc_id").pivot("side", ["pdf", "svg"]).agg((q("cx", 0.95) - q("cx", 0.05)).alias("x"), (q("cy", 0.95) - q("cy", 0.05)).alias("y"))
    floor_ = lambda c: F.greatest(F.col(c), F.lit(1e-6))
    return span.select("doc_id", (floor_("pdf_x") / floor_("svg_x")).alias("sx"), (floor_("pdf_y") / floor_("svg_y")).alias("sy"))


def candidate_order() -> list[Column]:
    """Order of scored candidates: score, length, tie, H before V, centre, id."""
    return [F.desc("score"), F.desc("len"), F.asc("tie"), F.asc("axis"), F.asc(F.col("cx") + F.col("cy")), F.asc("seg_id")]


def statistics(feat: DataFrame, *keys: str) -> DataFrame:
    """Counts, box, length and angle percentiles of each group; angles are folded to 0 to 90 degrees."""
    q = lambda c, p, name: F.percentile(c, F.lit(p)).alias(name)
    f = feat.withColumn("_fold", F.least(F.col("ang"), 180 - F.col("ang")))
    return f.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("axis") == "H").alias("n_h"), F.count_if(F.col("axis") == "V").alias("n_v"),
        F.min("len").alias("min_len"), q("len", 0.5, "p50_len"), q("len", 0.9, "p90_len"), F.max("len").alias("max_len"),
        q("_fold", 0.05, "p05_ang"), q("_fold", 0.5, "p50_ang"), q("_fold", 0.95, "p95_ang"),
    )


def object_counts(objects: DataFrame, *keys: str, kind: str = "kind") -> DataFrame:
    """How many objects of each kind a group has, and its share of them."""
    g = objects.groupBy(*keys, kind).agg(F.count("*").alias("n"))
    total = g.groupBy(*keys).agg(F.sum("n").alias("_all"))
    return g.join(total, list(keys)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def longest_part(edges_: DataFrame, *keys: str, least: float = 0.0, order: str = "i") -> DataFrame:
    """The longest edge of each polyline, if it is long enough; the first of equals."""
    e = edges_.withColumn("len", geom.length(geom.seg()))
    m = e.groupBy(*keys).agg(F.max_by(F.struct("x1", "y1", "x2", "y2", "len"), F.struct("len", -F.col(order))).alias("m"))
    return m.where(F.col("m.len") >= least).select(*keys, "m.*")


def touching_box(points: DataFrame, boxes: DataFrame, *keys: str, on: str = "doc_id", cell: float = 64.0) -> DataFrame:
    """Groups of points whose own box meets a query box (``on``, bx0, by0, bx1, by1); each group once for each box that it
    meets. Both kinds of boxes are put into the cells of a grid that they cover; a pair is found in the cell of the corner
    where the two begin to overlap, and so once."""
    g = points.groupBy(on, *keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    at = lambda c: F.floor(c / cell)
    cells = lambda df, a, b, c, d: df.withColumn("_gx", F.explode(F.sequence(at(F.col(a)), at(F.col(c))))).withColumn("_gy", F.explode(F.sequence(at(F.col(b)), at(F.col(d)))))
    j = cells(g, "x0", "y0", "x1", "y1").join(cells(boxes.where("bx0 <= bx1 and by0 <= by1"), "bx0", "by0", "bx1", "by1"), [on, "_gx", "_gy"])
    once = (F.col("_gx") == at(F.greatest("x0", "bx0"))) & (F.col("_gy") == at(F.greatest("y0", "by0")))
    return j.where("x0 <= bx1 and x1 >= bx0 and y0 <= by1 and y1 >= by0").where(once).drop("bx0", "by0", "bx1", "by1", "_gx", "_gy")
