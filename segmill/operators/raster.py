"""Operators on sparse rasters: tables of (doc_id, row, col) with a value where one is needed; absent pixels are 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmill.functions import geom

from . import spatial


def draw(segs: DataFrame, *keys: str, size: int, w: float | Column, h: float | Column, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Pixels (keys, row, col) of segments on a square canvas of ``size``: as many steps as the longer side has pixels,
    rounded half to even; what leaves the canvas is dropped."""
    u = lambda c: (F.col(c) - x0) / w * (size - 1)
    v = lambda c: (F.col(c) - y0) / h * (size - 1)
    s = segs.select(*keys, u("x1").alias("u1"), v("y1").alias("v1"), u("x2").alias("u2"), v("y2").alias("v2"))
    steps = F.greatest(F.ceil(F.greatest(F.abs(F.col("u2") - F.col("u1")), F.abs(F.col("v2") - F.col("v1")))), F.lit(1)).cast("long")
    s = s.withColumn("n", steps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    t = F.col("k") / F.col("n")
    p = s.select(*keys, F.rint(F.col("v1") + (F.col("v2") - F.col("v1")) * t).cast("long").alias("row"), F.rint(F.col("u1") + (F.col("u2") - F.col("u1")) * t).cast("long").alias("col"))
    p = p.where(F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1))
    # Equal pixels become one as bits of 64 columns: segments have many times the pixels that a canvas has words.
    word = F.shiftright("col", 6)
    bits = p.groupBy(*keys, "row", word.alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(col & 63 as int))")).alias("_bits"))
    on = bits.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(min(size, 64) - 1)))).where(F.expr("(shiftrightunsigned(_bits, _k) & 1) = 1"))
    return on.select(*keys, "row", (F.shiftleft("_word", 6) + F.col("_k")).alias("col"))


def render(segs: DataFrame, pages: DataFrame, *, zoom: float | None = None, size: int | None = None, y_up: bool = True) -> DataFrame:
    """Pages drawn at ``zoom`` pixels a unit (dots an inch / 72), or so that the longer side has ``size`` pixels: doc_id, row,
    col, val. ``pages`` has doc_id, w, h; a canvas has ceil(w * zoom) columns and ceil(h * zoom) rows, one at least. Ink is
    255, paper is absent: the gray value is 255 - val. Lines are one pixel wide, in the pixels that hold their steps, those on
    the far borders in the last ones; only the part on the canvas is stepped along, so its size bounds what a line costs. Segments of documents without a page, or with a null end, draw nothing."""
    if (zoom is None) == (size is None) or (zoom if size is None else size) <= 0:
        raise ValueError("one of zoom and size must be positive")
    z = F.lit(float(zoom)) if zoom is not None else F.lit(float(size)) / F.greatest("w", "h")
    canvas = pages.select("doc_id", F.col("h").alias("_h"), z.alias("_z"), *[F.greatest(F.ceil(F.col(c) * z), F.lit(1)).alias(n) for c, n in (("w", "_cols"), ("h", "_rows"))])
    u = lambda c: F.col(c) * F.col("_z")
    v = lambda c: ((F.col("_h") - F.col(c)) if y_up else F.col(c)) * F.col("_z")
    s = segs.select("doc_id", "x1", "y1", "x2", "y2").join(canvas, "doc_id").select("doc_id", "_rows", "_cols", u("x1").alias("u1"), v("y1").alias("v1"), u("x2").alias("u2"), v("y2").alias("v2"))
    du, dv = F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")

    def inside(first: Column, d: Column, n: Column) -> tuple[Column, Column]:
        """The share of the way at which a line enters the canvas and leaves it, along one axis."""
        flat = F.when(first.between(0, n), F.lit(0.0)).otherwise(F.lit(2.0))
        a, b = -first / d, (n - first) / d
        return F.when(d == 0, flat).otherwise(F.least(a, b)), F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(a, b))

    (x0, x1), (y0, y1) = inside(F.col("u1"), du, F.col("_cols")), inside(F.col("v1"), dv, F.col("_rows"))
    s = s.withColumns({"t0": F.greatest(F.lit(0.0), x0, y0), "t1": F.least(F.lit(1.0), x1, y1)}).where("u1 is not null and v1 is not null and u2 is not null and v2 is not null and t0 <= t1")
    held = lambda c, n: F.least(F.greatest(c, F.lit(0.0)), F.col(n))
    s = s.select("doc_id", "_rows", "_cols", *[held(F.col(f"{a}1") + d * F.col(f"t{e}"), n).alias(f"{a}{e}") for a, d, n in (("u", du, "_cols"), ("v", dv, "_rows")) for e in (0, 1)])
    s = s.withColumn("n", F.greatest(F.ceil(F.greatest(F.abs(F.col("u1") - F.col("u0")), F.abs(F.col("v1") - F.col("v0")))), F.lit(1)).cast("long"))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))).withColumn("t", F.col("k") / F.col("n"))
    on = lambda a, n: F.least(F.floor(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * F.col("t")), F.col(n) - 1)
    p = s.select("doc_id", on("v", "_rows").alias("row"), on("u", "_cols").alias("col"))
    return p.select("doc_id", "row", "col").distinct().withColumn("val", F.lit(255))


def preview(px: DataFrame, boxes: DataFrame, *, margin: int = 50) -> DataFrame:
    """``px`` (doc_id, row, col, val) within each document's box (doc_id, row0, col0, row1, col1) and ``margin`` pixels around
    it, rows and columns counted from the cut's upper left, which doesn't lie above or left of the canvas."""
    at = lambda c: F.greatest(F.col(c) - margin, F.lit(0))
    j = px.join(boxes.select("doc_id", at("row0").alias("_r"), at("col0").alias("_c"), (F.col("row1") + margin).alias("_r1"), (F.col("col1") + margin).alias("_c1")), "doc_id")
    j = j.where(F.col("row").between(F.col("_r"), F.col("_r1")) & F.col("col").between(F.col("_c"), F.col("_c1")))
    return j.select("doc_id", (F.col("row") - F.col("_r")).alias("row"), (F.col("col") - F.col("_c")).alias("col"), "val")


def overlap(a: DataFrame, b: DataFrame, size: int, shifts: DataFrame | None = None) -> DataFrame:
    """Share of the canvas that both rasters set, ``b`` rolled by (dr, dc) for each row of ``shifts`` (doc_id, dr, dc)."""
    b = b.join(shifts, "doc_id") if shifts is not None else b.withColumns({"dr": F.lit(0), "dc": F.lit(0)})
    rolled = b.select("doc_id", "dr", "dc", F.pmod(F.col("row") + F.col("dr"), F.lit(size)).alias("row"), F.pmod(F.col("col") + F.col("dc"), F.lit(size)).alias("col"))
    return rolled.join(a, ["doc_id", "row", "col"]).groupBy("doc_id", "dr", "dc").agg(F.count("*").alias("common")).withColumn("share", F.col("common") / float(size * size))


def gradient(px: DataFrame) -> DataFrame:
    """``px`` with g, the length of the gradient: central differences, one-sided at the borders of each row and column."""
    r, c = Window.partitionBy("doc_id", "row").orderBy("col"), Window.partitionBy("doc_id", "col").orderBy("row")

    def slope(w: Window) -> Column:
        back, ahead = F.lag("val").over(w), F.lead("val").over(w)
        return F.when(back.isNull() & ahead.isNull(), 0.0).when(back.isNull(), ahead - F.col("val")).when(ahead.isNull(), F.col("val") - back).otherwise((ahead - back) / 2)

    return px.withColumn("_gx", slope(r)).withColumn("_gy", slope(c)).withColumn("g", geom.norm(F.col("_gx"), F.col("_gy"))).drop("_gx", "_gy")


def runs(px: DataFrame, by: str = "row") -> DataFrame:
    """Runs of set pixels along rows (or columns) of at least two pixels: doc_id, dir, line, lo, hi."""
    line, at = ("row", "col") if by == "row" else ("col", "row")
    w = Window.partitionBy("doc_id", line).orderBy(at)
    g = px.select("doc_id", F.col(line).alias("line"), F.col(at).alias("at"), (F.col(at) - F.row_number().over(w)).alias("_k")).groupBy("doc_id", "line", "_k").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    return g.where("lo < hi").select("doc_id", F.lit("H" if by == "row" else "V").alias("dir"), "line", "lo", "hi")


def edge_segments(px: DataFrame, *, zoom: float, page_h: float, quantile: float = 0.97, floor_: float = 10.0, least: float = 6.0, most: int = 1500) -> DataFrame:
    """Segments of the edges in page raster ``px``: gradient above its quantile (and a floor), runs along rows and
    columns, pixel centres in page units with y upwards, at least ``least`` long, the ``most`` longest of each page."""
    g = gradient(px)
    cut = g.groupBy("doc_id").agg(F.greatest(F.percentile("g", F.lit(quantile)), F.lit(floor_)).alias("_cut"))
    edge = g.join(cut, "doc_id").where("g > _cut").select("doc_id", "row", "col")
    r = runs(edge, "row").unionByName(runs(edge, "col"))
    x, y = lambda c: (c + 0.5) / zoom, lambda c: page_h - (c + 0.5) / zoom
    h = F.col("dir") == "H"
    s = r.select("doc_id", F.when(h, x(F.col("lo"))).otherwise(x(F.col("line"))).alias("x1"), F.when(h, y(F.col("line"))).otherwise(y(F.col("lo"))).alias("y1"), F.when(h, x(F.col("hi"))).otherwise(x(F.col("line"))).alias("x2"), F.when(h, y(F.col("line"))).otherwise(y(F.col("hi"))).alias("y2"))
    s = s.withColumn("_q", (F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2).where(F.col("_q") >= least * least)
    w = Window.partitionBy("doc_id").orderBy(F.desc("_q"), "x1", "y1", "x2", "y2")
    return s.withColumn("seg_id", F.row_number().over(w).cast("long")).where(F.col("seg_id") <= most).drop("_q")


def turn(px: DataFrame, rows: int, cols: int, *, flip: str = "none", rot: int = 0) -> DataFrame:
    """Flip (x mirrors columns, y mirrors rows, xy both), then quarter turns against the clock, as index arithmetic."""
    r = rows - 1 - F.col("row") if "y" in flip else F.col("row")
    c = cols - 1 - F.col("col") if "x" in flip else F.col("col")
    for _ in range(rot // 90 % 4):
        r, c, rows, cols = cols - 1 - c, r, cols, rows
    return px.withColumns({"row": r, "col": c})


def place(px: DataFrame, dr: int, dc: int, rows: int, cols: int) -> DataFrame:
    """Moved by (dr, dc) and cropped to the canvas."""
    return px.withColumns({"row": F.col("row") + dr, "col": F.col("col") + dc}).where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))


def center_fit(px: DataFrame, rows: int, cols: int, to_rows: int, to_cols: int) -> DataFrame:
    """Cropped or padded to another canvas about the centre."""
    return place(px, (to_rows - rows) // 2, (to_cols - cols) // 2, to_rows, to_cols)


def normalised(px: DataFrame) -> DataFrame:
    """Values as shares of 255 in documents whose largest value is above 1."""
    top = px.groupBy("doc_id").agg(F.max("val").alias("_top"))
    return px.join(top, "doc_id").withColumn("val", F.when(F.col("_top") > 1, F.col("val") / 255.0).otherwise(F.col("val"))).drop("_top")


def ncc(pairs: DataFrame, *keys: str, a: str = "a", b: str = "b") -> DataFrame:
    """Normalised cross-correlation of two columns; 0 if one of them doesn't vary, null without rows."""
    g = pairs.groupBy(*keys).agg(F.corr(a, b).alias("_c"), F.stddev_pop(a).alias("_a"), F.stddev_pop(b).alias("_b"), F.count("*").alias("n"))
    return g.select(*keys, "n", F.when((F.col("_a") <= 1e-9) | (F.col("_b") <= 1e-9), 0.0).otherwise(F.col("_c")).alias("ncc"))


def distance_quality(svg: DataFrame, samples: DataFrame, *, size: int, w: float, h: float, hard: float) -> DataFrame:
    """Distances of sample points (px, py) from the drawn raster of ``svg``, in pixels: rmse, p95, median and
    1 / (1 + rmse) of each document. Only sampled pixels are looked up: within a narrow bound each among the drawn ones in
    its surroundings, within a wide one, where most of the canvas can be in its surroundings, in a map of distances."""
    mask = draw(svg, "doc_id", size=size, w=w, h=h).select("doc_id", F.col("col").cast("double").alias("rx"), F.col("row").cast("double").alias("ry"))
    at = lambda c, n: F.rint(F.least(F.greatest(F.col(c) / n * (size - 1), F.lit(0.0)), F.lit(float(size - 1))))
    p = samples.select("doc_id", at("px", w).alias("lx"), at("py", h).alias("ly")).groupBy("doc_id", "lx", "ly").agg(F.count("*").alias("k"))
    if hard <= NARROW:
        near = spatial.grid_join(p, mask, hard).groupBy("doc_id", "lx", "ly").agg(F.min("dist").alias("d"))
        d = p.join(near.hint(spatial.UNSENT), ["doc_id", "lx", "ly"], "left").withColumn("d", F.coalesce("d", F.lit(hard)))
    else:
        d = _looked_up(p, mask, size, hard)
    g = d.groupBy("doc_id").agg(F.sum("k").alias("n"), F.sqrt(F.sum(F.col("d") * F.col("d") * F.col("k")) / F.sum("k")).alias("rmse"), F.percentile("d", F.lit(0.95), F.col("k")).alias("p95"), F.percentile("d", F.lit(0.5), F.col("k")).alias("median"))
    return g.withColumn("score", 1 / (1 + F.col("rmse")))


#: The bound in pixels up to which a pixel is compared with each drawn one around it.
NARROW = 4.0


def _looked_up(p: DataFrame, mask: DataFrame, size: int, hard: float) -> DataFrame:
    """``p`` (doc_id, lx, ly, k) with d, the distance of the nearest pixel of ``mask`` (doc_id, rx, ry), at most ``hard``. A task
    holds the canvas of one document, whose pixels and sampled pixels are both distinct."""
    out = T.StructType([p.schema["doc_id"], T.StructField("k", T.LongType()), T.StructField("d", T.DoubleType())])

    def run(points: pa.Table, drawn: pa.Table) -> pa.Table:
        on = np.zeros((size, size), bool)
        on[drawn["ry"].to_numpy().astype(int), drawn["rx"].to_numpy().astype(int)] = True
        d = bounded_map(on, hard)[points["ly"].to_numpy().astype(int), points["lx"].to_numpy().astype(int)]
        return pa.table({"doc_id": points["doc_id"], "k": points["k"], "d": d}, schema=pa.schema([points.schema.field("doc_id"), ("k", pa.int64()), ("d", pa.float64())]))

    drawn = mask.where("doc_id is not null")  # as in a join, a null id meets no other
    return p.groupBy("doc_id").cogroup(drawn.groupBy("doc_id")).applyInArrow(run, out)


def bounded_map(mask: np.ndarray, hard: float) -> np.ndarray:
    """``distance_map``, at most ``hard``: columns are compared with those within the bound."""
    rows, cols = mask.shape
    reach = int(min(np.floor(hard), max(rows, cols)))
    d = np.where(mask, 0, reach + 1)
    for r in range(1, rows):  # within columns, downwards and upwards
        np.minimum(d[r], d[r - 1] + 1, out=d[r])
    for r in range(rows - 2, -1, -1):
        np.minimum(d[r], d[r + 1] + 1, out=d[r])
    q = np.where(d <= reach, d * d, np.iinfo(np.int64).max // 2)
    out = q.copy()
    for k in range(1, min(reach, cols - 1) + 1):
        np.minimum(out[:, k:], q[:, :-k] + k * k, out=out[:, k:])
        np.minimum(out[:, :-k], q[:, k:] + k * k, out=out[:, :-k])
    return np.minimum(np.sqrt(out), hard)


def distance_map(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each pixel from the nearest set one (infinite if none is): within columns first, then
    over the columns, one at a time, so that memory is that of a few rasters."""
    rows, cols = mask.shape
    d = np.where(mask, 0.0, np.inf)
    for r in range(1, rows):  # within columns, downwards and upwards
        d[r] = np.minimum(d[r], d[r - 1] + 1)
    for r in range(rows - 2, -1, -1):
        d[r] = np.minimum(d[r], d[r + 1] + 1)
    q, at = d * d, np.arange(cols)
    out = np.full_like(q, np.inf)
    for c in range(cols):
        np.minimum(out, q[:, c : c + 1] + (at - c) ** 2, out=out)
    return np.sqrt(out)


def distance_maps(px: DataFrame, rows: int, cols: int) -> DataFrame:
    """``distance_map`` of each document's set pixels (doc_id, row, col) as rows doc_id, row, col, d. A document's raster is
    all that one task holds."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((rows, cols), bool)
        mask[p.row.to_numpy(int), p.col.to_numpy(int)] = True
        r, c = np.indices((rows, cols))
        return pd.DataFrame({"doc_id": p.doc_id.iloc[0], "row": r.ravel(), "col": c.ravel(), "d": distance_map(mask).ravel()})

    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    return px.where(inside).select("doc_id", "row", "col").groupBy("doc_id").applyInPandas(run, "doc_id long, row long, col long, d double")


def resizes(px: DataFrame, rows: int, cols: int, to_rows: int, to_cols: int) -> DataFrame:
    """``resized`` of each document's raster (doc_id, row, col, val; pixels without a row are 0)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        v = resized(_dense(p, (rows, cols)), to_rows, to_cols)
        r, c = np.indices(v.shape)
        return pd.DataFrame({"doc_id": p.doc_id.iloc[0], "row": r.ravel(), "col": c.ravel(), "val": v.ravel()})

    return px.select("doc_id", "row", "col", "val").groupBy("doc_id").applyInPandas(run, "doc_id long, row long, col long, val double")


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Shift (du columns, dv rows) that lays ``b`` over ``a``, by phase correlation, and the height of its peak."""
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    r = np.real(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)))
    v, u = np.unravel_index(int(r.argmax()), r.shape)
    rows, cols = r.shape
    return int(u if u <= cols // 2 else u - cols), int(v if v <= rows // 2 else v - rows), float(r.max())


def product_shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """The same by the raw product, without normalisation."""
    r = np.real(np.fft.ifft2(np.fft.fft2(a) * np.conj(np.fft.fft2(b))))
    v, u = np.unravel_index(int(r.argmax()), r.shape)
    rows, cols = r.shape
    return int(u if u <= cols // 2 else u - cols), int(v if v <= rows // 2 else v - rows), float(r.max())


def resized(v: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Bilinear, pixel centres on pixel centres."""
    r = np.clip((np.arange(rows) + 0.5) * v.shape[0] / rows - 0.5, 0, v.shape[0] - 1)
    c = np.clip((np.arange(cols) + 0.5) * v.shape[1] / cols - 0.5, 0, v.shape[1] - 1)
    r0, c0 = r.astype(int), c.astype(int)
    r1, c1 = np.minimum(r0 + 1, v.shape[0] - 1), np.minimum(c0 + 1, v.shape[1] - 1)
    fr, fc = (r - r0)[:, None], (c - c0)[None, :]
    return v[r0][:, c0] * (1 - fr) * (1 - fc) + v[r0][:, c1] * (1 - fr) * fc + v[r1][:, c0] * fr * (1 - fc) + v[r1][:, c1] * fr * fc


def _dense(rows: pd.DataFrame, size: tuple[int, int]) -> np.ndarray:
    v = np.zeros(size)
    v[rows.row.to_numpy(int), rows.col.to_numpy(int)] = rows.val.to_numpy(float)
    return v


def phase_shifts(px: DataFrame, rows: int, cols: int) -> DataFrame:
    """Phase correlation of the two sides of each document (doc_id, side, row, col, val): doc_id, du, dv, response. One
    group is one page's canvas, which has rows * cols pixels whatever the input's size."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        u, v, r = phase_shift(_dense(p[p.side == "pdf"], (rows, cols)), _dense(p[p.side == "svg"], (rows, cols)))
        return pd.DataFrame({"doc_id": [p.doc_id.iloc[0]], "du": [u], "dv": [v], "response": [r]})

    return px.groupBy("doc_id").applyInPandas(run, "doc_id long, du int, dv int, response double")


def raster_orientation(px: DataFrame, rows: int, cols: int) -> DataFrame:
    """The best of four turns and three flips of the svg canvas by the response of its phase correlation with the pdf
    canvas (padded to one size); the first of equals: doc_id, rot, flip, du, dv, score."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        n = max(rows, cols)
        a = np.zeros((n, n))
        a[:rows, :cols] = _dense(p[p.side == "pdf"], (rows, cols))
        b, best = _dense(p[p.side == "svg"], (rows, cols)), None
        for flip in ("none", "x", "y"):
            f = b[:, ::-1] if flip == "x" else b[::-1] if flip == "y" else b
            for rot in (0, 90, 180, 270):
                t = np.rot90(f, rot // 90)
                c = np.zeros((n, n))
                c[: t.shape[0], : t.shape[1]] = t
                u, v, r = phase_shift(a, c)
                r = r if np.isfinite(r) else 0.0
                if best is None or r > best[-1]:
                    best = (rot, flip, u, v, r)
        return pd.DataFrame([(p.doc_id.iloc[0], *best)], columns=["doc_id", "rot", "flip", "du", "dv", "score"])

    return px.groupBy("doc_id").applyInPandas(run, "doc_id long, rot int, flip string, du int, dv int, score double")


def raster_scale(px: DataFrame, rows: int, cols: int, *, low: float, high: float, coarse: float = 0.01, window: float = 0.02, fine: float = 0.001) -> DataFrame:
    """The scale of the svg canvas, about the centre, with the largest NCC: a coarse grid, then a fine one around its
    best, which wins only if it isn't worse: doc_id, scale, ncc."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b = (_dense(p[p.side == s], (rows, cols)) for s in ("pdf", "svg"))

        def score(s: float) -> float:
            r, c = max(1, round(rows * s)), max(1, round(cols * s))
            t, out = resized(b, r, c), np.zeros((rows, cols))
            dr, dc = (rows - r) // 2, (cols - c) // 2
            src = t[max(0, -dr) : max(0, -dr) + rows, max(0, -dc) : max(0, -dc) + cols]
            out[max(0, dr) : max(0, dr) + src.shape[0], max(0, dc) : max(0, dc) + src.shape[1]] = src
            if a.std() <= 1e-9 or out.std() <= 1e-9:
                return 0.0
            return float(((a - a.mean()) * (out - out.mean())).mean() / (a.std() * out.std()))

        grid = lambda lo, hi, step: lo + step * np.arange(int(np.floor((hi - lo) / step + 1e-9)) + 1)
        best = max(((score(s), -k, s) for k, s in enumerate(grid(low, high, coarse))))
        near = max(((score(s), -k, s) for k, s in enumerate(grid(max(low, best[2] - window), min(high, best[2] + window), fine))))
        s = near if near[0] >= best[0] else best
        return pd.DataFrame({"doc_id": [p.doc_id.iloc[0]], "scale": [s[2]], "ncc": [s[0]]})

    return px.groupBy("doc_id").applyInPandas(run, "doc_id long, scale double, ncc double")


def draw_upright(segs: DataFrame, *keys: str, size: int, w: float | Column, h: float | Column) -> DataFrame:
    """``draw`` for y-up coordinates on a canvas whose rows go down: ends are rounded to pixels first, and what leaves the
    canvas is clipped to its border."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), F.rint(c)))
    s = segs.select(*keys, *[clip(F.col(c) * (size - 1) / w).alias(c) for c in ("x1", "x2")], *[clip((h - F.col(c)) * (size - 1) / h).alias(c) for c in ("y1", "y2")])
    return draw(s, *keys, size=size, w=float(size - 1), h=float(size - 1))


def crop_margin(px: DataFrame, rows: int, cols: int, share: float) -> DataFrame:
    """Without a border of ``share`` of each side."""
    dr, dc = int(rows * share), int(cols * share)
    return place(px, -dr, -dc, rows - 2 * dr, cols - 2 * dc)
