"""Search by tables of hypotheses: which turn, flip, scale and shift lays one drawing over another.

Every hypothesis of every document is scored in one job; the best is an aggregate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.durable import materialize
from segmill.functions import geom

from . import profiles, raster, spatial


def flips(spark: SparkSession, rots: tuple[int, ...] = (0, 180)) -> DataFrame:
    """hyp_id, rot, fx, fy: every turn with every flip; a fixed number of rows."""
    rows = [(i, r, fx, fy) for i, (r, fx, fy) in enumerate((r, fx, fy) for r in rots for fx, fy in ((1, 1), (-1, 1), (1, -1), (-1, -1)))]
    return spark.createDataFrame(rows, "hyp_id int, rot int, fx int, fy int")


def turns(spark: SparkSession) -> DataFrame:
    """hyp_id, rot, flip of the coarse search: four turns, three flips; a fixed number of rows."""
    rows = [(i, r, f) for i, (r, f) in enumerate((r, f) for r in (0, 90, 180, 270) for f in ("none", "x", "y"))]
    return spark.createDataFrame(rows, "hyp_id int, rot int, flip string")


def _mirrors() -> tuple[Column, Column]:
    """Whether a hypothesis (rot, fx, fy) mirrors x, and y: a half turn mirrors both."""
    turned = F.col("rot") == 180
    return (F.col("fx") < 0) != turned, (F.col("fy") < 0) != turned


def about_centre(segs: DataFrame, hyps: DataFrame, w: float, h: float) -> DataFrame:
    """Each segment under each hypothesis: turned by 0 or 180 degrees about the page's centre, then flipped about it."""
    s = segs.crossJoin(F.broadcast(hyps))
    mx, my = _mirrors()
    x = lambda c: F.when(mx, w - F.col(c)).otherwise(F.col(c))
    y = lambda c: F.when(my, h - F.col(c)).otherwise(F.col(c))
    return s.withColumns({"x1": x("x1"), "y1": y("y1"), "x2": x("x2"), "y2": y("y2")})


def _counted(segs: DataFrame, keys: list[str], w: float, h: float, bins: int) -> DataFrame:
    """Counts of centres by profile and bin of the page."""
    cx, cy = geom.center(geom.seg())
    p = F.explode(F.array(F.struct(F.lit("x").alias("profile"), (cx / w).alias("t")), F.struct(F.lit("y").alias("profile"), (cy / h).alias("t")))).alias("p")
    s = segs.select(*keys, p).select(*keys, "p.*").where("t >= 0 and t <= 1")
    return s.withColumn("bin", F.least(F.floor(F.col("t") * bins), F.lit(bins - 1)).cast("int")).groupBy(*keys, "profile", "bin").agg(F.count("*").alias("n"))


def _dense(c: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """All bins of each profile as one array, of counts less their mean; as long as a profile has bins."""
    g = c.groupBy(*keys, "profile").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), (F.sum("n") / float(bins)).alias("mean"))
    return g.select(*keys, "profile", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) - F.col("mean")).alias("v"))


def mean_free_shift(a: DataFrame, b: DataFrame, keys: list[str], on: list[str], bins: int) -> DataFrame:
    """Shift of the largest full correlation of mean-free profiles: keys, profile, shift (bins by which ``b`` follows
    ``a``), c (normalised); of equals the smallest shift."""
    j = a.select(*keys, "profile", F.col("v").alias("a")).join(b.select(*on, "profile", F.col("v").alias("b")), [*on, "profile"])
    j = j.withColumn("shift", F.explode(F.sequence(F.lit(1 - bins), F.lit(bins - 1))))
    dot = F.aggregate(F.sequence(F.greatest(F.lit(0), -F.col("shift")), F.least(F.lit(bins - 1), F.lit(bins - 1) - F.col("shift"))), F.lit(0.0), lambda s, i: s + F.get("a", i) * F.get("b", i + F.col("shift")))
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    c = j.withColumn("c", F.round(dot / F.greatest(size("a") * size("b"), F.lit(1e-12)), 9))
    return c.groupBy(*keys, "profile").agg(F.max(F.struct("c", (-F.col("shift")).alias("o"))).alias("m")).select(*keys, "profile", (-F.col("m.o")).alias("shift"), F.col("m.c").alias("c"))


def orientation(pdf: DataFrame, svg: DataFrame, hyps: DataFrame, *, w: float, h: float, svg_w: float, svg_h: float, bins: int = 40, size: int = 64) -> DataFrame:
    """Every hypothesis of every document: shifts dx, dy, the overlap of the drawn rasters after them, and the ranking
    key, overlap less a quarter of the relative shift."""
    unit = svg.withColumns({c: F.col(c) * ((w / svg_w) if c[0] == "x" else (h / svg_h)) for c in ("x1", "y1", "x2", "y2")})
    # Hypotheses that mirror alike see the same image (at most four of them), which is made once: hyp_id is the image's below.
    image = F.when(_mirrors()[0], 2).otherwise(0) + F.when(_mirrors()[1], 1).otherwise(0)
    images = hyps.select(image.alias("hyp_id")).distinct()
    images = images.select("hyp_id", F.lit(0).alias("rot"), F.when(F.col("hyp_id") >= 2, -1).otherwise(1).alias("fx"), F.when(F.col("hyp_id") % 2 == 1, -1).otherwise(1).alias("fy"))
    moved = about_centre(pdf.select("doc_id", "x1", "y1", "x2", "y2"), images, w, h)
    a = _dense(_counted(moved, ["doc_id", "hyp_id"], w, h, bins), ["doc_id", "hyp_id"], bins)
    b = _dense(_counted(unit, ["doc_id"], w, h, bins), ["doc_id"], bins)
    s = mean_free_shift(a, b, ["doc_id", "hyp_id"], ["doc_id"], bins)
    s = s.groupBy("doc_id", "hyp_id").pivot("profile", ["x", "y"]).agg(F.first("shift").alias("shift"), F.first("c").alias("c"))
    s = s.select("doc_id", "hyp_id", (F.coalesce("x_shift", F.lit(0)) * (w / bins)).alias("dx"), (F.coalesce("y_shift", F.lit(0)) * (h / bins)).alias("dy"), ((F.coalesce("x_c", F.lit(0.0)) + F.coalesce("y_c", F.lit(0.0))) / 2).alias("response"))
    at = s.select("doc_id", "hyp_id", F.rint(F.col("dx") / w * (size - 1)).cast("int").alias("dc"), F.rint(F.col("dy") / h * (size - 1)).cast("int").alias("dr"))
    mine = raster.draw(moved, "doc_id", "hyp_id", size=size, w=w, h=h).join(at, ["doc_id", "hyp_id"])
    mine = mine.select("doc_id", "hyp_id", F.pmod(F.col("row") + F.col("dr"), F.lit(size)).alias("row"), F.pmod(F.col("col") + F.col("dc"), F.lit(size)).alias("col"))
    common = mine.join(raster.draw(unit, "doc_id", size=size, w=w, h=h).hint(spatial.UNSENT), ["doc_id", "row", "col"]).groupBy("doc_id", "hyp_id").agg(F.count("*").alias("common"))
    out = s.join(common, ["doc_id", "hyp_id"], "left").withColumnRenamed("hyp_id", "_image").join(F.broadcast(hyps.withColumn("_image", image)), "_image")
    share = F.coalesce("common", F.lit(0)) / float(size * size)
    return out.select("doc_id", "hyp_id", "rot", "fx", "fy", "dx", "dy", "response", share.alias("overlap"), (share - 0.25 * (F.abs(F.col("dx")) / w + F.abs(F.col("dy")) / h)).alias("key"))


def best(hyps: DataFrame, *score: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The hypothesis of each document with the largest score columns, of equals that of the first level, then the first."""
    rest = [c for c in hyps.columns if c not in keys]
    first = [(-F.col(c)).alias(f"f{i}") for i, c in enumerate(("level", "hyp_id")) if c in hyps.columns]
    order = F.struct(*[F.round(c, 9).alias(f"o{i}") for i, c in enumerate(score)], *first)
    m = hyps.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("m"))
    return m.select(*keys, "m.*")


Box = tuple[float, float, float, float]


def _boxed(df: DataFrame, box: Box | DataFrame, names: str) -> DataFrame:
    """``df`` with the box (x, y, width, height) as columns: one for all documents, or a table with a box a document."""
    cols = [names + c for c in ("x0", "y0", "w", "h")]
    if isinstance(box, DataFrame):
        return df.join(box.select("doc_id", *[F.col(a).alias(b) for a, b in zip(("x0", "y0", "w", "h"), cols, strict=True)]), "doc_id")
    return df.withColumns({c: F.lit(v) for c, v in zip(cols, box, strict=True)})


def boxes(feat: DataFrame) -> DataFrame:
    """The box of each document's segments: doc_id, x0, y0, w, h."""
    from . import segments

    side = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(1e-6))
    return segments.bbox(feat, "doc_id").select("doc_id", F.col("min_x").alias("x0"), F.col("min_y").alias("y0"), side("max_x", "min_x").alias("w"), side("max_y", "min_y").alias("h"))


def _levels(feat: DataFrame, shares: tuple[float, ...], tols: tuple[float, ...]) -> DataFrame:
    """A row for each level whose share of a document's longest segments holds the segment (at least one), with the
    level's tolerance: level (shares first, then tolerances), tol."""
    at = lambda i: F.array(*[F.struct(F.lit(i * len(tols) + j).alias("level"), F.lit(float(t)).alias("tol")) for j, t in enumerate(tols)])
    if shares == (1.0,):
        return feat.withColumn("_l", F.explode(at(0))).select("*", "_l.*").drop("_l")
    n = feat.groupBy("doc_id").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("len"), "seg_id")
    r = feat.join(n, "doc_id").withColumn("_r", F.row_number().over(w))
    within = F.flatten(F.array(*[F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)), at(i)).otherwise(F.array().cast("array<struct<level:int,tol:double>>")) for i, share in enumerate(shares)]))
    return r.withColumn("_l", F.explode(within)).select("*", "_l.*").drop("_l", "_n", "_r")


def _once(df: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """The columns ``kept`` (all by default) and ``made``, which what follows takes as values. As plain columns their formulas
    are copied into every use and null check that follows, and a generated method of over 8000 bytes is never compiled."""
    return df.select(*(kept or ("*",)), F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))


def coarse(pdf: DataFrame, svg: DataFrame, hyps: DataFrame, box_pdf: Box | DataFrame, box_svg: Box | DataFrame, *, bins: int = 64, dist_tol: float = 12.0, angle_tol: float = 6.0, len_tol: float = 0.15, shares: tuple[float, ...] = (0.1, 0.2, 0.4), tols: tuple[float, ...] = (6.0, 8.0, 10.0), least: int = 4, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> DataFrame:
    """Coarse search from the drawing to the page: for each level (a share of the longest segments, and a tolerance by which
    they follow an axis) and each hypothesis the profiles' correlations cx, cy, the scale by boxes, the shift in bins and
    the inliers of all segments; score = weighted sum. Levels with fewer than ``least`` segments on a side are left out.
    Sides have len and ang."""
    lits = [F.col(c) for c in ("x0", "y0", "w", "h")]
    turned = F.col("rot") % 180 == 90

    def profile(d: DataFrame, keys: list[str], box: str, hz: Column) -> DataFrame:
        t = F.when(hz, (F.col("mx") - F.col(box + "x0")) / F.col(box + "w")).otherwise((F.col("my") - F.col(box + "y0")) / F.col(box + "h"))
        k = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * bins), F.lit(bins - 1)).cast("int")
        return d.groupBy(*keys, F.when(hz, "X").otherwise("Y").alias("profile"), k.alias("bin")).agg(F.sum("len").alias("w"))

    # A quarter turn makes upright segments level ones and the other way round; flips and half turns leave them.
    long_pdf, long_svg = (_levels(d.select("doc_id", "seg_id", "cx", "cy", "len", "ang"), shares, tols).withColumn("axis", geom.axis(F.col("ang"), F.col("tol"))) for d in (pdf, svg))
    flat = F.col("axis") == "H"
    mine = _boxed(long_pdf.where("axis is not null"), box_pdf, "p").withColumns({"mx": F.col("cx"), "my": F.col("cy")})
    mine = profile(mine, ["doc_id", "level"], "p", flat).select(F.lit("pdf").alias("side"), "*").crossJoin(F.broadcast(hyps.select("hyp_id")))
    mid = geom.coarse_point(F.col("cx"), F.col("cy"), F.col("rot"), F.col("flip"), *lits)
    other = _boxed(long_svg.where("axis is not null"), box_svg, "").crossJoin(F.broadcast(hyps)).withColumns({"mx": mid[0], "my": mid[1]})
    other = profile(other, ["doc_id", "level", "hyp_id"], "", flat != turned).select(F.lit("svg").alias("side"), "*")
    names, keys = ["side", "doc_id", "level", "hyp_id", "profile", "bin", "w"], ("doc_id", "level", "hyp_id", "profile")
    # Written, as it is read four times: for both sides' products and their norms.
    both = materialize(mine.select(*names).unionByName(other.select(*names)), "profiles")
    c = profiles.xcorr(both, bins, keys=keys).withColumn("c", F.round("c", 9))
    top = profiles.peak(c, *keys).groupBy("doc_id", "level", "hyp_id").pivot("profile", ["X", "Y"]).agg(F.first("shift").alias("shift"), F.first("peak").alias("peak"))
    enough = long_pdf.groupBy("doc_id", "level").agg(F.count("*").alias("a")).join(long_svg.groupBy("doc_id", "level").agg(F.count("*").alias("b")), ["doc_id", "level"]).where(F.least("a", "b") >= least).select("doc_id", "level")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    top = top.join(enough, ["doc_id", "level"]).select("doc_id", "level", "hyp_id", F.coalesce("X_peak", F.lit(0.0)).alias("cx"), F.coalesce("Y_peak", F.lit(0.0)).alias("cy"), zero("X_shift").alias("kx"), zero("Y_shift").alias("ky"))
    top = materialize(top, "peaks")
    # Inliers depend on the hypothesis and its shift alone, which many levels share.
    spot = ["doc_id", "hyp_id", "kx", "ky"]
    u, v = geom.coarse_vector(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("rot"), F.col("flip"))
    sx, sy = F.col("pw") / F.col("w"), F.col("ph") / F.col("h")
    there = svg.select("doc_id", "x1", "y1", "x2", "y2", "cx", "cy").join(top.select(*spot).distinct().join(F.broadcast(hyps), "hyp_id").hint(spatial.UNSENT), "doc_id")
    there = _once(_boxed(_boxed(there, box_svg, ""), box_pdf, "p"), mx=mid[0], my=mid[1], u=u * sx, v=v * sy)
    there = there.select(*spot, ((F.col("mx") - F.col("x0")) * sx + F.col("px0") + F.col("kx") * (F.col("pw") / bins)).alias("lx"), ((F.col("my") - F.col("y0")) * sy + F.col("py0") + F.col("ky") * (F.col("ph") / bins)).alias("ly"), geom.norm(F.col("u"), F.col("v")).alias("s_len"), geom.angle180(geom.Seg(F.lit(0.0), F.lit(0.0), F.col("u"), F.col("v"))).alias("s_ang"))
    here = _once(pdf, "doc_id", rx=F.col("cx"), ry=F.col("cy"), p_len=F.col("len"), p_ang=F.col("ang"))
    ok = (geom.angle_gap(F.col("p_ang"), F.col("s_ang")) <= angle_tol) & (F.col("p_len") > 0) & (F.col("s_len") / F.col("p_len")).between(1 - len_tol, 1 + len_tol)
    near = spatial.grid_join(there, here, dist_tol).where(ok).groupBy(*spot).agg(F.sum(F.least("p_len", "s_len")).alias("near"))
    total = there.groupBy(*spot).agg(F.sum("s_len").alias("total"))
    inliers = total.join(near.hint(spatial.UNSENT), spot, "left").withColumn("inliers", F.coalesce("near", F.lit(0.0)) / F.col("total"))
    out = _boxed(_boxed(top.join(inliers.hint(spatial.UNSENT), spot), box_svg, ""), box_pdf, "p").join(F.broadcast(hyps), "hyp_id")
    score = weights[0] * F.col("cx") + weights[1] * F.col("cy") + weights[2] * F.col("inliers")
    return out.select("doc_id", "level", "hyp_id", "rot", "flip", "cx", "cy", (F.col("kx") * (F.col("pw") / bins)).alias("dx"), (F.col("ky") * (F.col("ph") / bins)).alias("dy"), "inliers", score.alias("score"), sx.alias("sx"), sy.alias("sy"))


def heatmap_shift(pdf: DataFrame, svg: DataFrame, *, size: int = 64) -> DataFrame:
    """The fallback of the coarse search: the shift in cells of the largest circular product correlation of both sides'
    heatmaps over their own boxes, without a turn or a flip: doc_id, kx, ky, score. ``pdf`` and ``svg`` have cx, cy. A
    document's raster of size times size cells is all that one task holds."""
    both = pdf.select("doc_id", F.lit("pdf").alias("side"), "x1", "y1", "x2", "y2", "cx", "cy").unionByName(svg.select("doc_id", F.lit("svg").alias("side"), "x1", "y1", "x2", "y2", "cx", "cy"))
    from . import segments

    cells = profiles.heatmap(both, segments.bbox(both, "doc_id", "side"), size)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        v = {side: np.zeros((size, size)) for side in ("pdf", "svg")}
        for side, own in p.groupby("side"):
            v[side][own.iy.to_numpy(int), own.ix.to_numpy(int)] = own.v.to_numpy(float)
        kx, ky, top = raster.product_shift(v["pdf"], v["svg"])
        return pd.DataFrame({"doc_id": [p.doc_id.iloc[0]], "kx": [kx], "ky": [ky], "score": [top]})

    return cells.groupBy("doc_id").applyInPandas(run, "doc_id long, kx int, ky int, score double")


def coarse_best(pdf: DataFrame, svg: DataFrame, **options: object) -> DataFrame:
    """The best of ``coarse`` of each document over its own boxes, or the heatmaps' shift (level -1) where no level had
    enough segments: doc_id, level, rot, flip, sx, sy, dx, dy, score and the boxes' columns."""
    bp, bs = materialize(boxes(pdf), "boxes"), materialize(boxes(svg), "boxes")
    got = materialize(best(coarse(pdf, svg, turns(pdf.sparkSession), bp, bs, **options), "score").select("doc_id", "level", "rot", "flip", "sx", "sy", "dx", "dy", "score"), "coarse")
    lost = bp.join(bs.select("doc_id"), "doc_id").select("doc_id").join(got, "doc_id", "left_anti")
    size = 64
    rest = heatmap_shift(pdf.join(lost, "doc_id", "left_semi"), svg.join(lost, "doc_id", "left_semi"), size=size)
    rest = _boxed(_boxed(rest, bs, ""), bp, "p").select("doc_id", F.lit(-1).alias("level"), F.lit(0).alias("rot"), F.lit("none").alias("flip"), (F.col("pw") / F.col("w")).alias("sx"), (F.col("ph") / F.col("h")).alias("sy"), (F.col("kx") * (F.col("pw") / size)).alias("dx"), (F.col("ky") * (F.col("ph") / size)).alias("dy"), "score")
    return _boxed(_boxed(got.unionByName(rest), bs, ""), bp, "p")


def coarse_moved(svg: DataFrame, found: DataFrame) -> DataFrame:
    """The drawing's segments where the coarse search puts them on the page. ``found`` is what ``coarse_best`` gives."""
    j = svg.join(found.drop("score", "level"), "doc_id")
    box = [F.col(c) for c in ("x0", "y0", "w", "h")]
    end = lambda x, y: geom.coarse_point(F.col(x), F.col(y), F.col("rot"), F.col("flip"), *box)
    at = lambda p: ((p[0] - F.col("x0")) * F.col("sx") + F.col("px0") + F.col("dx"), (p[1] - F.col("y0")) * F.col("sy") + F.col("py0") + F.col("dy"))
    (x1, y1), (x2, y2) = at(end("x1", "y1")), at(end("x2", "y2"))
    return j.select(*[{"x1": x1, "y1": y1, "x2": x2, "y2": y2}[c].alias(c) if c in ("x1", "y1", "x2", "y2") else F.col(c) for c in ("doc_id", "side", "seg_id", "x1", "y1", "x2", "y2")])


def page_alignment(pages: DataFrame) -> DataFrame:
    """One row a document from the two page sizes: turn (0 or 90 by which sides agree within 5 %), scales, aspect
    agreement and the confidence it gives."""
    p = pages.groupBy("doc_id").pivot("side", ["pdf", "svg"]).agg(F.first("w").alias("w"), F.first("h").alias("h"))
    a, b = F.col("pdf_w") / F.col("pdf_h"), F.col("svg_w") / F.col("svg_h")
    straight, crossed = geom.nearly(a, b), geom.nearly(a, 1 / b)
    rot = F.when(straight, 0).when(crossed, 90).otherwise(0)
    sx = F.when(rot == 90, F.col("svg_w") / F.col("pdf_h")).otherwise(F.col("svg_w") / F.col("pdf_w"))
    sy = F.when(rot == 90, F.col("svg_h") / F.col("pdf_w")).otherwise(F.col("svg_h") / F.col("pdf_h"))
    sure = F.when(straight | crossed, F.when(geom.nearly(sx, sy), "high").otherwise("medium")).otherwise("low")
    return p.select("doc_id", rot.alias("rot"), F.lit(True).alias("flip_y"), sx.alias("sx"), sy.alias("sy"), sure.alias("confidence"), F.concat(F.lit("pagebox:"), sure).alias("source"))


def diagnostics(models: DataFrame, pages: DataFrame, tol: float | None = None) -> DataFrame:
    """What a model does to its page: tolerance (0.2 % of the diagonal, at least 0.5), shift, mean scale, whether it
    mirrors, and a flag for shifts within the tolerance."""
    p = pages.where("side = 'pdf'").select("doc_id", geom.norm(F.col("w"), F.col("h")).alias("diag"))
    t: Column = F.lit(tol) if tol is not None else F.greatest(F.col("diag") * 0.002, F.lit(0.5))
    shift = geom.norm(F.col("tx"), F.col("ty"))
    return models.join(p, "doc_id").select("doc_id", t.alias("tol"), shift.alias("shift"), ((F.col("sx") + F.col("sy")) / 2).alias("scale"), (F.col("fx") * F.col("fy") < 0).alias("mirrored"), (shift <= t).alias("aligned"), geom.flip_name(F.col("fx"), F.col("fy")).alias("flip"))
