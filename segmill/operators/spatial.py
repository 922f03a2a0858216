"""Joins by distance, as equi-joins of grid cells with the distance as a residual.

Both sides are keyed by document and cell, so a join is a hash or sort-merge join and never a nested loop; a cell that
holds many rows is split by adaptive execution like any skewed key. Sides that are repeated over cells are never broadcast
(``UNSENT``): Spark takes them for as small as the file that they come from, and the driver would have to hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions import geom


#: The join hint of what is repeated over cells: sorted by the cell on both sides.
UNSENT = "merge"


def _cell(c: Column, size: float | Column) -> Column:
    return F.floor(c / size).cast("long")


def _around(c: Column, size: float | Column) -> Column:
    k = _cell(c, size)
    return F.explode(F.sequence(k - 1, k + 1))


def grid_join(left: DataFrame, right: DataFrame, radius: float | Column, *, keys: tuple[str, ...] = ("doc_id",), lx: str = "lx", ly: str = "ly", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """Pairs whose points are at most ``radius`` apart, with their distance ``dist``; each pair once. Columns other than
    the keys must differ by name. The right side is repeated for the nine cells around each of its points: give the
    smaller side there. ``radius`` may be a column of both sides' keys."""
    wide = F.greatest(F.lit(radius) if not isinstance(radius, Column) else radius, F.lit(1e-9))
    a = left.withColumn("_gx", _cell(F.col(lx), wide)).withColumn("_gy", _cell(F.col(ly), wide))
    b = right.withColumn("_gx", _around(F.col(rx), wide)).withColumn("_gy", _around(F.col(ry), wide))
    d = geom.norm(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry))
    return a.join(b.hint(UNSENT), [*keys, "_gx", "_gy"]).withColumn("dist", d).where(F.col("dist") <= wide).drop("_gx", "_gy")


def covered_cells(df: DataFrame, s: geom.Seg, size: float, margin: float = 0.0) -> DataFrame:
    """``df`` with a row for each cell (_gx, _gy) that has a point within ``margin`` (along either axis) of a segment: in each
    column of cells, the rows that the segment's part above that column reaches. So a slanted segment covers cells in
    proportion to its length, not to its box."""
    lo, hi = F.least(s.x1, s.x2), F.greatest(s.x1, s.x2)
    wide = df.withColumn("_gx", F.explode(F.sequence(_cell(lo - margin, size), _cell(hi + margin, size))))
    # The segment within the column, widened; of no width if it is upright, where all of it is within.
    slope = (s.y2 - s.y1) / (s.x2 - s.x1)
    left, right = F.greatest(lo, F.col("_gx") * size - margin), F.least(hi, (F.col("_gx") + 1) * size + margin)
    at = lambda x: s.y1 + (x - s.x1) * slope
    # A column meets the box by a margin of rounding at most where ``left`` is beyond ``right``.
    flat = (s.x1 == s.x2) | (left > right)
    low = F.when(flat, F.least(s.y1, s.y2)).otherwise(F.greatest(F.least(at(left), at(right)), F.least(s.y1, s.y2)))
    high = F.when(flat, F.greatest(s.y1, s.y2)).otherwise(F.least(F.greatest(at(left), at(right)), F.greatest(s.y1, s.y2)))
    eps = 1e-6 * size  # for rounding of the crossing points
    return wide.withColumn("_gy", F.explode(F.sequence(_cell(low - margin - eps, size), _cell(high + margin + eps, size))))


def cell_size(segs: DataFrame, *, per_cell: float = 40.0, keys: tuple[str, ...] = ("doc_id",), halvings: int = 6) -> DataFrame:
    """Keys and ``cell``: the box's larger side over 32, halved until cells hold ``per_cell`` segments on average or
    ``halvings`` times."""
    box = segs.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("w"), (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("h"))
    side = F.greatest(F.col("w"), F.col("h"), F.lit(1e-6))
    need = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / (32.0 * 32.0 * per_cell))) / 2)
    return box.select(*keys, (side / 32 / F.pow(F.lit(2.0), F.least(need, F.lit(halvings)))).alias("cell"))


def cover(segs: DataFrame, hard: float, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The segments in every cell that has a point within ``hard`` of them: what ``nearest`` looks into."""
    return covered_cells(segs.select(*keys, "x1", "y1", "x2", "y2"), geom.seg(), hard, hard)


#: Rows of a cell up to which the cells of a task are held in memory while points stream by.
CELL_ROWS = 50_000


#: Sides of a cell in bounds, where cells are looked into only once: a third of the rows to deal out and sort that cells as
#: wide as the bound have, for half as many pairs more.
WIDE = 2.0


def hashable(cells: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> bool:
    """Whether no cell of ``cover`` is so full that it must not be held in memory."""
    most = cells.groupBy(*keys, "_gx", "_gy").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= CELL_ROWS


def nearest(points: DataFrame, segs: DataFrame | None, hard: float, *, keys: tuple[str, ...] = ("doc_id",), px: str = "px", py: str = "py", cells: DataFrame | None = None, hashed: bool = False) -> DataFrame:
    """``points`` with ``d``, the distance of the nearest segment, at most ``hard``. Equal points are one row. A point looks
    into its own cell only. Where the same segments are looked into again and again, give ``cells`` (written, from
    ``cover``), and ``hashed`` if they are ``hashable``: then points aren't sorted for the join."""
    size = hard if cells is not None else WIDE * hard
    cells = covered_cells(segs.select(*keys, "x1", "y1", "x2", "y2"), geom.seg(), size, hard) if cells is None else cells
    cells = cells.hint("shuffle_hash" if hashed else UNSENT)
    p = points.withColumn("_gx", _cell(F.col(px), size)).withColumn("_gy", _cell(F.col(py), size))
    d = geom.point_to_segment(F.col(px), F.col(py), geom.seg())
    # Grouped by the cell as well, as which the join has dealt the rows out, so that they needn't be dealt out again.
    got = p.join(cells, [*keys, "_gx", "_gy"], "left").groupBy(*points.columns, "_gx", "_gy").agg(F.min(d).alias("d")).drop("_gx", "_gy")
    return got.withColumn("d", F.coalesce(F.least(F.col("d"), F.lit(hard)), F.lit(hard)))


def gate_matches(pdf: DataFrame, svg: DataFrame, *, angle_tol: float, len_tol: float, dist_tol: float) -> DataFrame:
    """Pairs with near centres, like directions and like lengths. Sides have seg_id, cx, cy, len, ang."""
    a = pdf.select("doc_id", F.col("seg_id").alias("p_id"), F.col("cx").alias("lx"), F.col("cy").alias("ly"), F.col("len").alias("p_len"), F.col("ang").alias("p_ang"))
    b = svg.select("doc_id", F.col("seg_id").alias("s_id"), F.col("cx").alias("rx"), F.col("cy").alias("ry"), F.col("len").alias("s_len"), F.col("ang").alias("s_ang"))
    ratio = F.col("s_len") / F.col("p_len")
    ok = (F.col("p_len") > 0) & (geom.angle_gap(F.col("p_ang"), F.col("s_ang")) <= angle_tol) & ratio.between(1 - len_tol, 1 + len_tol)
    return grid_join(a, b, dist_tol).where(ok).select("doc_id", "p_id", "s_id", "dist", "p_len", "s_len")


def inlier_score(pairs: DataFrame, svg: DataFrame) -> DataFrame:
    """Sum over the pairs of the shorter length, over the total length of the drawing; a segment counts in each pair."""
    total = svg.groupBy("doc_id").agg(F.sum("len").alias("total"))
    got = pairs.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum(F.least("p_len", "s_len")).alias("near"))
    return total.join(got, "doc_id", "left").select("doc_id", F.coalesce("pairs", F.lit(0)).alias("pairs"), (F.coalesce("near", F.lit(0.0)) / F.col("total")).alias("score"))


def candidate_pairs(lines: DataFrame, svg: DataFrame, radius: float) -> DataFrame:
    """Lines and segments of the same axis whose gap is at most ``radius``, with ``gap``; each pair once."""
    a = covered_cells(lines.select("doc_id", "axis", F.col("seg_id").alias("p_id"), *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2", "len")]), geom.seg("p_"), 2 * radius)
    b = covered_cells(svg.select("doc_id", "axis", F.col("seg_id").alias("s_id"), *[F.col(c).alias(f"s_{c}") for c in ("x1", "y1", "x2", "y2", "len")]), geom.seg("s_"), 2 * radius, radius)
    gap = geom.segment_gap(geom.seg("p_"), geom.seg("s_"))
    met = a.join(b.hint(UNSENT), ["doc_id", "axis", "_gx", "_gy"]).drop("_gx", "_gy").withColumn("gap", gap).where(F.col("gap") <= radius)
    return met.dropDuplicates(["doc_id", "p_id", "s_id"])


def geometric_cost(radius: float, *, max_angle: float = 6.0, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """Cost of a pair (p_, s_ columns) by ends, midpoints and directions; null if the directions differ too much."""
    p, s, r = geom.seg("p_"), geom.seg("s_"), max(radius, 1e-6)
    same = geom.norm(p.x1 - s.x1, p.y1 - s.y1) + geom.norm(p.x2 - s.x2, p.y2 - s.y2)
    crossed = geom.norm(p.x1 - s.x2, p.y1 - s.y2) + geom.norm(p.x2 - s.x1, p.y2 - s.y1)
    (ax, ay), (bx, by) = geom.center(p), geom.center(s)
    (ux, uy), (vx, vy) = geom.direction(p), geom.direction(s)
    dot = F.least(F.abs(ux * vx + uy * vy), F.lit(1.0))
    cost = weights[0] * F.least(same, crossed) / (2 * r) + weights[1] * geom.norm(ax - bx, ay - by) / r + weights[2] * (1 - dot)
    return F.when(F.degrees(F.acos(dot)) <= max_angle, cost)


def signatures(refs: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """A row for each neighbour of each reference segment: doc_id, seg_id, n_id and t, dtheta, rho, the neighbour's place
    along the segment, its turn and its relative length. A neighbour has a near centre, an axis and a length."""
    a = refs.where("len > 0").select("doc_id", "seg_id", F.col("cx").alias("rx"), F.col("cy").alias("ry"), "x1", "y1", "x2", "y2", F.col("len").alias("r_len"), F.col("ang").alias("r_ang"))
    b = others.where("axis is not null and len > 0").select("doc_id", F.col("seg_id").alias("n_id"), F.col("cx").alias("lx"), F.col("cy").alias("ly"), F.col("len").alias("n_len"), F.col("ang").alias("n_ang"))
    near = grid_join(b, a, radius).where("seg_id <> n_id")
    ux, uy = (F.col("x2") - F.col("x1")) / F.col("r_len"), (F.col("y2") - F.col("y1")) / F.col("r_len")
    t = ((F.col("lx") - F.col("x1")) * ux + (F.col("ly") - F.col("y1")) * uy) / F.col("r_len")
    return near.select("doc_id", "seg_id", "n_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)).alias("t"), geom.angle_gap(F.col("r_ang"), F.col("n_ang")).alias("dtheta"), F.least(F.col("n_len") / F.col("r_len"), F.lit(5.0)).alias("rho"))


def signature_arrays(rows: DataFrame) -> DataFrame:
    """``sig``: the neighbours of each segment as an array of (t, dtheta, rho) in ascending order."""
    return rows.groupBy("doc_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("t", "dtheta", "rho"))).alias("sig"))
