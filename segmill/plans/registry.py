"""Registered queries over the driver's tables, each with the SQL that it is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.functions import geom, parse
from segmill.operators import fit, hypotheses, labels, match, profiles, raster, segments, spatial
from segmill.plans import pipeline
from segmill.plans import preprocess as preprocess_
from segmill.plans import scan
from segmill.sources import content, derived, pdf, svg
from segmill.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

W, H = derived.PAGE_W, derived.PAGE_H
SW, SH = derived.PAGE_W * derived.SX, derived.PAGE_H * derived.SY


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; ``sql`` follows the common table expressions of the derived tables."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            ORACLE_SQL[f.__name__] = "WITH " + derived.SQL.strip() + ("" if body.startswith(",") else "\n") + body
        return f

    return put


def halves_up(df: DataFrame, *names: str, digits: int) -> DataFrame:
    """``rounded`` as the SQL engine does it: the product with the power of ten decides, not the shortest decimal form."""
    unit = 10.0**digits

    def of(c: str) -> Column:
        y = F.abs(F.col(c)) * unit
        whole = F.floor(y).cast("double")
        return F.signum(c) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / unit + 0.0

    return df.withColumns({c: of(c) for c in names})


def feat(spark: SparkSession, d: str, side: str | None = None) -> DataFrame:
    """Segments with their features, of one side or both."""
    parts = {"pdf": derived.segments_pdf, "svg": derived.segments_svg}
    if side:
        return segments.features(parts[side](spark, d))
    return segments.features(parts["pdf"](spark, d).unionByName(parts["svg"](spark, d)))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, as engines may differ in their last bits; minus zero as zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in names})


@query("SELECT side, doc_id, seg_id, round(len, 6) AS len, round(ang, 6) AS ang, round(cx, 6) AS cx, round(cy, 6) AS cy, axis, round(least(ang, 180 - ang), 6) AS gap_h FROM feat")
def seg_features(spark: SparkSession, d: str) -> DataFrame:
    f = feat(spark, d).withColumn("gap_h", geom.angle_gap(F.col("ang"), F.lit(0.0)))
    return rounded(f.select("side", "doc_id", "seg_id", "len", "ang", "cx", "cy", "axis", "gap_h"), "len", "ang", "cx", "cy", "gap_h")


@query("""SELECT side, doc_id, count(*) AS n, count(*) FILTER (axis = 'H') AS n_h, count(*) FILTER (axis = 'V') AS n_v, count(*) FILTER (axis IS NULL) AS n_other,
  round(min(least(x1, x2)), 6) AS min_x, round(min(least(y1, y2)), 6) AS min_y, round(max(greatest(x1, x2)), 6) AS max_x, round(max(greatest(y1, y2)), 6) AS max_y,
  round(sum(len), 4) AS total, round(min(len), 6) AS min_len, round(quantile_cont(len, 0.5), 6) AS p50_len, round(quantile_cont(len, 0.9), 6) AS p90_len, round(max(len), 6) AS max_len
FROM feat GROUP BY side, doc_id""")
def seg_axis_summary(spark: SparkSession, d: str) -> DataFrame:
    s = segments.axis_summary(feat(spark, d), "side", "doc_id")
    return rounded(rounded(s, "min_x", "min_y", "max_x", "max_y", "min_len", "p50_len", "p90_len", "max_len"), "total", digits=4)


@query("SELECT side, doc_id, count(*) FILTER (axis = 'H') AS n_h, count(*) FILTER (axis = 'V') AS n_v, CASE WHEN count(*) FILTER (axis = 'H') = 0 AND count(*) FILTER (axis = 'V') = 0 THEN 'no axis' WHEN count(*) FILTER (axis = 'V') = 0 THEN 'no vertical' WHEN count(*) FILTER (axis = 'H') = 0 THEN 'no horizontal' ELSE 'ok' END AS status FROM feat GROUP BY ALL")
def seg_axes_present(spark: SparkSession, d: str) -> DataFrame:
    return segments.axes_present(feat(spark, d), "side", "doc_id")


@query("""SELECT side, doc_id, seg_id, axis2 AS dominant, code, orient, mask_h, mask_v, round(ux, 6) AS ux, round(uy, 6) AS uy FROM (
  SELECT *, coalesce(axis, CASE WHEN abs(x2 - x1) >= abs(y2 - y1) THEN 'H' ELSE 'V' END) AS axis2,
    CASE WHEN least(ang, 180 - ang) <= 0.5 THEN 0 WHEN abs(ang - 90) <= 0.5 THEN 1 ELSE -1 END AS code,
    CASE WHEN abs(degrees(atan2(y2 - y1, x2 - x1))) < 10 OR abs(abs(degrees(atan2(y2 - y1, x2 - x1))) - 180) < 10 THEN 'h' WHEN abs(abs(degrees(atan2(y2 - y1, x2 - x1))) - 90) < 10 THEN 'v' ELSE 'diag' END AS orient,
    least(ang, 180 - ang) <= 3 AS mask_h, abs(ang - 90) <= 3 AS mask_v, (x2 - x1) / len AS ux, (y2 - y1) / len AS uy FROM feat)""")
def seg_classes(spark: SparkSession, d: str) -> DataFrame:
    s = geom.seg()
    (ux, uy), (mh, mv) = geom.direction(s), geom.hv_mask(s, 3.0)
    f = feat(spark, d).select("side", "doc_id", "seg_id", geom.axis_or_dominant(s).alias("dominant"), geom.axis_code(F.col("ang")).alias("code"), geom.loose_orientation(s).alias("orient"), mh.alias("mask_h"), mv.alias("mask_v"), ux.alias("ux"), uy.alias("uy"))
    return rounded(f, "ux", "uy")


@query(""", k AS (SELECT *, len >= 0.15e0 * CASE side WHEN 'pdf' THEN sqrt(1000e0 * 1000e0 + 800e0 * 800e0) ELSE sqrt(1012e0 * 1012e0 + 794.4e0 * 794.4e0) END AS long_ FROM feat)
SELECT side, doc_id, seg_id, round(len, 6) AS len FROM (SELECT *, count(*) FILTER (long_) OVER (PARTITION BY side, doc_id) AS n FROM k) WHERE long_ OR n = 0""")
def seg_prefilter_keep_all(spark: SparkSession, d: str) -> DataFrame:
    f = segments.prefilter(feat(spark, d), derived.pages(spark, d), 0.15)
    return rounded(f.select("side", "doc_id", "seg_id", "len"), "len")


@query("""SELECT side, doc_id, seg_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY side, doc_id ORDER BY len DESC, seg_id) AS rank,
  count(*) OVER (PARTITION BY side, doc_id) AS n FROM feat) WHERE rank <= greatest(16, floor(n * 0.1e0))""")
def seg_topk_rel(spark: SparkSession, d: str) -> DataFrame:
    return segments.top_relative(feat(spark, d), 0.1, 16).select("side", "doc_id", "seg_id", "rank")


@query("SELECT side, doc_id, seg_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY side, doc_id ORDER BY len DESC, seg_id) AS rank FROM feat) WHERE rank <= 50")
def seg_topk_abs(spark: SparkSession, d: str) -> DataFrame:
    return segments.top_absolute(feat(spark, d), 50, "side", "doc_id").select("side", "doc_id", "seg_id", "rank")


@query("SELECT side, doc_id, axis, seg_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY side, doc_id, axis ORDER BY len DESC, seg_id) AS rank FROM feat WHERE axis IS NOT NULL) WHERE rank <= 20")
def seg_topk_axis(spark: SparkSession, d: str) -> DataFrame:
    return segments.top_absolute(feat(spark, d).where("axis is not null"), 20, "side", "doc_id", "axis").select("side", "doc_id", "axis", "seg_id", "rank")


@query("""SELECT side, doc_id, seg_id,
  round(CASE axis WHEN 'H' THEN least(x1, x2) WHEN 'V' THEN cx ELSE x1 END, 6) AS x1, round(CASE axis WHEN 'H' THEN cy WHEN 'V' THEN least(y1, y2) ELSE y1 END, 6) AS y1,
  round(CASE axis WHEN 'H' THEN greatest(x1, x2) WHEN 'V' THEN cx ELSE x2 END, 6) AS x2, round(CASE axis WHEN 'H' THEN cy WHEN 'V' THEN greatest(y1, y2) ELSE y2 END, 6) AS y2 FROM feat""")
def seg_axis_snap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.snap(feat(spark, d)).select("side", "doc_id", "seg_id", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2")


@query(""", s AS (SELECT side, doc_id, axis, seg_id, len, CASE axis WHEN 'H' THEN least(x1, x2) ELSE least(y1, y2) END AS lo, CASE axis WHEN 'H' THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS hi,
    CASE axis WHEN 'H' THEN cy ELSE cx END AS off FROM feat WHERE axis IS NOT NULL),
b AS (SELECT *, round_even(off / 2e0, 0) AS bucket FROM s),
r AS (SELECT *, max(hi) OVER (PARTITION BY side, doc_id, axis, bucket ORDER BY lo, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo - reach > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY side, doc_id, axis, bucket ORDER BY lo, seg_id ROWS UNBOUNDED PRECEDING) AS island FROM r),
m AS (SELECT side, doc_id, axis, bucket, island, min(lo) AS lo, max(hi) AS hi, sum(off * len) / sum(len) AS pos, count(*) AS n FROM i GROUP BY ALL)
SELECT side, doc_id, axis, round(CASE axis WHEN 'H' THEN lo ELSE pos END, 5) AS x1, round(CASE axis WHEN 'H' THEN pos ELSE lo END, 5) AS y1, round(CASE axis WHEN 'H' THEN hi ELSE pos END, 5) AS x2, round(CASE axis WHEN 'H' THEN pos ELSE hi END, 5) AS y2, n FROM m
UNION ALL SELECT side, doc_id, axis, round(x1, 5), round(y1, 5), round(x2, 5), round(y2, 5), 1 FROM feat WHERE axis IS NULL""")
def seg_merge_collinear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.merge_collinear(feat(spark, d), off_tol=2.0, gap_max=3.0), "x1", "y1", "x2", "y2", digits=5)


_BOX = "box AS (SELECT side, doc_id, min(least(x1, x2)) AS min_x, max(greatest(x1, x2)) AS max_x, min(least(y1, y2)) AS min_y, max(greatest(y1, y2)) AS max_y FROM feat GROUP BY side, doc_id)"
_PROFILE = _BOX + """, prof AS (SELECT side, doc_id, CASE axis WHEN 'H' THEN 'X' ELSE 'Y' END AS profile,
  CASE axis WHEN 'H' THEN least(floor(greatest(0e0, least(1e0, (cx - min_x) / greatest(max_x - min_x, 1e-6))) * 64), 63) ELSE least(floor(greatest(0e0, least(1e0, (cy - min_y) / greatest(max_y - min_y, 1e-6))) * 64), 63) END::INT AS bin, sum(len) AS w
  FROM feat JOIN box USING (side, doc_id) WHERE axis IS NOT NULL GROUP BY ALL)"""


@query(", " + _PROFILE + " SELECT side, doc_id, profile, bin, round(w, 5) AS w FROM prof")
def hist_projection(spark: SparkSession, d: str) -> DataFrame:
    f = feat(spark, d)
    return rounded(profiles.projection(f, segments.bbox(f, "side", "doc_id"), 64), "w", digits=5).select("side", "doc_id", "profile", "bin", "w")


@query(""", c AS (SELECT side, doc_id, 'X' AS profile, cx AS c, CASE side WHEN 'pdf' THEN 1000e0 ELSE 1000e0 * 1.012e0 END AS extent FROM feat UNION ALL SELECT side, doc_id, 'Y', cy, CASE side WHEN 'pdf' THEN 800e0 ELSE 800e0 * 0.993e0 END FROM feat),
b AS (SELECT *, greatest(16, ceil(extent / 25))::INT AS bins FROM c WHERE c >= 0 AND c <= extent)
SELECT side, doc_id, profile, bins, least(floor(c / extent * bins), bins - 1)::INT AS bin, count(*) AS n FROM b GROUP BY ALL""")
def hist_axis_counts(spark: SparkSession, d: str) -> DataFrame:
    return profiles.counts(feat(spark, d), derived.pages(spark, d), 25.0).select("side", "doc_id", "profile", "bins", "bin", "n")


@query(", " + _BOX + """, h AS (SELECT side, doc_id, least(floor(greatest(0e0, least(1e0, (cy - min_y) / greatest(max_y - min_y, 1e-6))) * 32), 31)::INT AS iy, least(floor(greatest(0e0, least(1e0, (cx - min_x) / greatest(max_x - min_x, 1e-6))) * 32), 31)::INT AS ix, count(*) AS n FROM feat JOIN box USING (side, doc_id) GROUP BY ALL)
SELECT side, doc_id, iy, ix, round(n / max(n) OVER (PARTITION BY side, doc_id), 6) AS v FROM h""")
def hist_heatmap(spark: SparkSession, d: str) -> DataFrame:
    f = feat(spark, d)
    return rounded(profiles.heatmap(f, segments.bbox(f, "side", "doc_id"), 32), "v").select("side", "doc_id", "iy", "ix", "v")


@query(""", q AS (SELECT side, doc_id, quantile_cont(cx, 0.95) - quantile_cont(cx, 0.05) AS x, quantile_cont(cy, 0.95) - quantile_cont(cy, 0.05) AS y FROM feat GROUP BY side, doc_id)
SELECT a.doc_id, round(greatest(a.x, 1e-6) / greatest(b.x, 1e-6), 6) AS sx, round(greatest(a.y, 1e-6) / greatest(b.y, 1e-6), 6) AS sy FROM q a JOIN q b USING (doc_id) WHERE a.side = 'pdf' AND b.side = 'svg'""")
def quantile_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.quantile_spans(feat(spark, d)), "sx", "sy")


@query(", " + _PROFILE + """, a AS (SELECT * FROM prof WHERE side = 'pdf'), b AS (SELECT * FROM prof WHERE side = 'svg'),
na AS (SELECT doc_id, profile, sqrt(sum(w * w)) AS n FROM a GROUP BY ALL), nb AS (SELECT doc_id, profile, sqrt(sum(w * w)) AS n FROM b GROUP BY ALL),
c AS (SELECT a.doc_id, a.profile, a.bin - b.bin AS shift, sum(a.w * b.w) AS s FROM a JOIN b USING (doc_id, profile) GROUP BY ALL)
SELECT c.doc_id, c.profile, c.shift, round(c.s / (na.n * nb.n), 6) AS c FROM c JOIN na USING (doc_id, profile) JOIN nb USING (doc_id, profile)""")
def xcorr_profiles(spark: SparkSession, d: str) -> DataFrame:
    f = feat(spark, d)
    return rounded(profiles.xcorr(profiles.projection(f, segments.bbox(f, "side", "doc_id"), 64), 64), "c").select("doc_id", "profile", "shift", "c")


@query(", " + _PROFILE + """, a AS (SELECT * FROM prof WHERE side = 'pdf'), b AS (SELECT * FROM prof WHERE side = 'svg'),
na AS (SELECT doc_id, profile, sqrt(sum(w * w)) AS n FROM a GROUP BY ALL), nb AS (SELECT doc_id, profile, sqrt(sum(w * w)) AS n FROM b GROUP BY ALL),
c AS (SELECT a.doc_id, a.profile, a.bin - b.bin AS shift, sum(a.w * b.w) AS s FROM a JOIN b USING (doc_id, profile) GROUP BY ALL),
n AS (SELECT doc_id, profile, shift, s / (na.n * nb.n) AS c FROM c JOIN na USING (doc_id, profile) JOIN nb USING (doc_id, profile))
SELECT doc_id, profile, shift, round(c, 6) AS peak FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, profile ORDER BY round(c, 9) DESC, CASE WHEN shift >= 0 THEN shift ELSE shift + 100000 END) = 1""")
def xcorr_peaks_fft(spark: SparkSession, d: str) -> DataFrame:
    f = feat(spark, d)
    return rounded(profiles.xcorr_fft(profiles.projection(f, segments.bbox(f, "side", "doc_id"), 64), 64), "peak")


@query(""", p AS (SELECT p.doc_id, p.seg_id AS p_id, s.seg_id AS s_id, sqrt((p.cx - s.cx) * (p.cx - s.cx) + (p.cy - s.cy) * (p.cy - s.cy)) AS dist FROM fp p JOIN fs s USING (doc_id))
SELECT doc_id, p_id, s_id, round(dist, 6) AS dist FROM p WHERE dist <= 20""")
def grid_radius_join(spark: SparkSession, d: str) -> DataFrame:
    a = feat(spark, d, "pdf").select("doc_id", F.col("seg_id").alias("p_id"), F.col("cx").alias("lx"), F.col("cy").alias("ly"))
    b = feat(spark, d, "svg").select("doc_id", F.col("seg_id").alias("s_id"), F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    return rounded(spatial.grid_join(a, b, 20.0).select("doc_id", "p_id", "s_id", "dist"), "dist")


_GATE = """p AS (SELECT p.doc_id, p.seg_id AS p_id, s.seg_id AS s_id, sqrt((p.cx - s.cx) * (p.cx - s.cx) + (p.cy - s.cy) * (p.cy - s.cy)) AS dist, p.len AS p_len, s.len AS s_len, abs(p.ang - s.ang) AS da FROM fp p JOIN fs s USING (doc_id)),
g AS (SELECT * FROM p WHERE dist <= 20 AND least(da, 180 - da) <= 5 AND s_len / p_len BETWEEN 0.8e0 AND 1.2e0)"""


@query(", " + _GATE + " SELECT doc_id, p_id, s_id, round(dist, 6) AS dist FROM g")
def gate_matches(spark: SparkSession, d: str) -> DataFrame:
    g = spatial.gate_matches(feat(spark, d, "pdf"), feat(spark, d, "svg"), angle_tol=5.0, len_tol=0.2, dist_tol=20.0)
    return rounded(g.select("doc_id", "p_id", "s_id", "dist"), "dist")


@query(", " + _GATE + """, t AS (SELECT doc_id, sum(len) AS total FROM fs GROUP BY doc_id)
SELECT t.doc_id, count(p_id) AS pairs, round(coalesce(sum(least(p_len, s_len)), 0) / any_value(total), 6) AS score FROM t LEFT JOIN g USING (doc_id) GROUP BY t.doc_id""")
def inlier_score(spark: SparkSession, d: str) -> DataFrame:
    svg = feat(spark, d, "svg")
    return rounded(spatial.inlier_score(spatial.gate_matches(feat(spark, d, "pdf"), svg, angle_tol=5.0, len_tol=0.2, dist_tol=20.0), svg), "score")


def _ptseg(px: str, py: str, q: str) -> str:
    t = f"greatest(0e0, least(1e0, (({px} - {q}.x1) * ({q}.x2 - {q}.x1) + ({py} - {q}.y1) * ({q}.y2 - {q}.y1)) / (({q}.x2 - {q}.x1) * ({q}.x2 - {q}.x1) + ({q}.y2 - {q}.y1) * ({q}.y2 - {q}.y1))))"
    return f"sqrt(pow({px} - ({q}.x1 + {t} * ({q}.x2 - {q}.x1)), 2) + pow({py} - ({q}.y1 + {t} * ({q}.y2 - {q}.y1)), 2))"


_CAND = f"""lines AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, axis ORDER BY len DESC, seg_id) AS k FROM fp WHERE axis IS NOT NULL) WHERE k <= 10),
cand AS (SELECT p.doc_id, p.axis, p.seg_id AS p_id, s.seg_id AS s_id, least({_ptseg('p.x1', 'p.y1', 's')}, {_ptseg('p.x2', 'p.y2', 's')}, {_ptseg('s.x1', 's.y1', 'p')}, {_ptseg('s.x2', 's.y2', 'p')}) AS gap,
  sqrt(pow(p.x1 - s.x1, 2) + pow(p.y1 - s.y1, 2)) + sqrt(pow(p.x2 - s.x2, 2) + pow(p.y2 - s.y2, 2)) AS same_, sqrt(pow(p.x1 - s.x2, 2) + pow(p.y1 - s.y2, 2)) + sqrt(pow(p.x2 - s.x1, 2) + pow(p.y2 - s.y1, 2)) AS cross_,
  sqrt(pow(p.cx - s.cx, 2) + pow(p.cy - s.cy, 2)) AS mid, least(1e0, abs((p.x2 - p.x1) / p.len * ((s.x2 - s.x1) / s.len) + (p.y2 - p.y1) / p.len * ((s.y2 - s.y1) / s.len))) AS dot
  FROM lines p JOIN fs s USING (doc_id, axis))"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return segments.top_absolute(feat(spark, d, "pdf").where("axis is not null"), 10, "doc_id", "axis").drop("rank")


@query(", " + _CAND + " SELECT doc_id, axis, p_id, s_id, round(gap, 5) AS gap FROM cand WHERE gap <= 15")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = spatial.candidate_pairs(_lines(spark, d), feat(spark, d, "svg").where("axis is not null"), 15.0)
    return rounded(c.select("doc_id", "axis", "p_id", "s_id", "gap"), "gap", digits=5)


@query(", " + _CAND + " SELECT doc_id, p_id, s_id, CASE WHEN degrees(acos(dot)) <= 6 THEN round(least(same_, cross_) / 30 + mid / 15 + 1 - dot, 5) END AS cost FROM cand WHERE gap <= 15")
def candidate_cost_geo(spark: SparkSession, d: str) -> DataFrame:
    c = spatial.candidate_pairs(_lines(spark, d), feat(spark, d, "svg").where("axis is not null"), 15.0)
    return rounded(c.select("doc_id", "p_id", "s_id", spatial.geometric_cost(15.0).alias("cost")), "cost", digits=5)


_PTS = """pts AS (SELECT doc_id, seg_id, i, x1 + (x2 - x1) * (i / n) AS px, y1 + (y2 - y1) * (i / n) AS py FROM (SELECT *, unnest(range(0, n::BIGINT + 1)) AS i FROM (SELECT *, greatest(ceil(len / 20), 1) AS n FROM fp)))"""
_NEAR = _PTS + f""", m AS (SELECT p.doc_id, p.seg_id, p.i, p.px * 1.012e0 + 4.2e0 AS px, p.py * 0.993e0 - 5.6e0 AS py FROM pts p),
near AS (SELECT m.doc_id, m.seg_id, m.i, min(least(10e0, {_ptseg('m.px', 'm.py', 's')})) AS d FROM m JOIN fs s USING (doc_id) GROUP BY ALL)"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    p = segments.sample_steps(feat(spark, d, "pdf"), 20.0)
    p = p.withColumns({"px": F.col("px") * derived.SX + derived.TX, "py": F.col("py") * derived.SY + derived.TY})
    return spatial.nearest(p, feat(spark, d, "svg"), 10.0)


@query(", " + _PTS + " SELECT doc_id, seg_id, i, round(px, 6) AS px, round(py, 6) AS py FROM pts")
def sample_steps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.sample_steps(feat(spark, d, "pdf"), 20.0), "px", "py")


@query("SELECT doc_id, seg_id, i::INT AS pt_id, round(x1 + (x2 - x1) * (i / 17e0), 6) AS px, round(y1 + (y2 - y1) * (i / 17e0), 6) AS py FROM (SELECT *, unnest(range(1, 17)) AS i FROM fp)")
def sample_inside(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.sample_inside(feat(spark, d, "pdf")).select("doc_id", "seg_id", "pt_id", "px", "py"), "px", "py")


@query(", " + _NEAR + " SELECT doc_id, seg_id, i, round(d, 5) AS d FROM near")
def nearest_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_near(spark, d).select("doc_id", "seg_id", "i", "d"), "d", digits=5)


@query(", " + _NEAR + " SELECT doc_id, count(*) AS n, round(avg(CASE WHEN d < 10 THEN exp(-d * d / 32) ELSE 0 END), 6) AS score, round(sqrt(avg(d * d)), 5) AS rmse, round(quantile_cont(d, 0.95), 5) AS p95, round(quantile_cont(d, 0.5), 5) AS median FROM near GROUP BY doc_id")
def residual_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(segments.residuals(_near(spark, d), "doc_id", sigma=4.0, hard=10.0), "score"), "rmse", "p95", "median", digits=5)


@query(", " + _PTS + f""", hyp AS (SELECT * FROM (VALUES (0, 1.012e0, 0.993e0, 4.2e0, -5.6e0), (1, 1.02e0, 1e0, 0e0, 0e0), (2, 1e0, 1e0, 5e0, -5e0), (3, 0.99e0, 0.98e0, 10e0, 0e0)) h(hyp_id, sx, sy, tx, ty)),
m AS (SELECT hyp_id, doc_id, seg_id, i, px * sx + tx AS px, py * sy + ty AS py FROM pts, hyp), near AS (SELECT m.hyp_id, m.doc_id, m.seg_id, m.i, min(least(10e0, {_ptseg('m.px', 'm.py', 's')})) AS d FROM m JOIN fs s USING (doc_id) GROUP BY ALL)
SELECT doc_id, hyp_id, count(*) AS n, round(avg(CASE WHEN d < 10 THEN exp(-d * d / 32) ELSE 0 END), 6) AS score FROM near GROUP BY ALL""")
def chamfer_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    hyp = spark.createDataFrame([(0, 1.012, 0.993, 4.2, -5.6), (1, 1.02, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 5.0, -5.0), (3, 0.99, 0.98, 10.0, 0.0)], "hyp_id int, sx double, sy double, tx double, ty double")
    p = segments.sample_steps(feat(spark, d, "pdf"), 20.0).crossJoin(F.broadcast(hyp))
    p = p.select("doc_id", "hyp_id", "seg_id", "i", (F.col("px") * F.col("sx") + F.col("tx")).alias("px"), (F.col("py") * F.col("sy") + F.col("ty")).alias("py"))
    return rounded(segments.residuals(spatial.nearest(p, feat(spark, d, "svg"), 10.0), "doc_id", "hyp_id", sigma=4.0, hard=10.0).select("doc_id", "hyp_id", "n", "score"), "score")


@query(""", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, axis ORDER BY len DESC, seg_id) AS k FROM fp WHERE axis IS NOT NULL) WHERE k <= 10),
p AS (SELECT doc_id, seg_id, len, i, x1 + (x2 - x1) * (i / n) AS px, y1 + (y2 - y1) * (i / n) AS py FROM (SELECT *, unnest(range(0, n::BIGINT + 1)) AS i FROM (SELECT *, greatest(ceil(len / 20), 1) AS n FROM l))),
m AS (SELECT doc_id, seg_id, len, i, px * 1.012e0 + 4.2e0 AS px, py * 0.993e0 - 5.6e0 AS py FROM p),
near AS (SELECT m.doc_id, m.seg_id, m.len, m.i, min(least(10e0, """ + _ptseg("m.px", "m.py", "s") + """)) AS d FROM m JOIN fs s USING (doc_id) GROUP BY ALL)
SELECT doc_id, seg_id, round(avg(CASE WHEN d < 10 THEN exp(-d * d / 32) ELSE 0 END) * any_value(len), 5) AS support FROM near GROUP BY doc_id, seg_id""")
def line_support(spark: SparkSession, d: str) -> DataFrame:
    ln = _lines(spark, d)
    p = segments.sample_steps(ln, 20.0).withColumns({"px": F.col("px") * derived.SX + derived.TX, "py": F.col("py") * derived.SY + derived.TY})
    near = segments.residuals(spatial.nearest(p, feat(spark, d, "svg"), 10.0), "doc_id", "seg_id", sigma=4.0, hard=10.0)
    return rounded(near.join(ln.select("doc_id", "seg_id", "len"), ["doc_id", "seg_id"]).select("doc_id", "seg_id", (F.col("score") * F.col("len")).alias("support")), "support", digits=5)


@query(""", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, axis ORDER BY len DESC, seg_id) AS k FROM fp WHERE axis IS NOT NULL) WHERE k <= 10)
SELECT r.doc_id, r.seg_id, n.seg_id AS n_id, round(greatest(0e0, least(1e0, ((n.cx - r.x1) * ((r.x2 - r.x1) / r.len) + (n.cy - r.y1) * ((r.y2 - r.y1) / r.len)) / r.len)), 6) AS t, round(least(abs(r.ang - n.ang), 180 - abs(r.ang - n.ang)), 6) AS dtheta, round(least(n.len / r.len, 5e0), 6) AS rho
FROM l r JOIN fp n ON r.doc_id = n.doc_id AND r.seg_id <> n.seg_id WHERE n.axis IS NOT NULL AND sqrt((r.cx - n.cx) * (r.cx - n.cx) + (r.cy - n.cy) * (r.cy - n.cy)) <= 60""")
def neighbor_signature(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.signatures(_lines(spark, d), feat(spark, d, "pdf"), 60.0), "t", "dtheta", "rho")


_DIM = """val AS (SELECT doc_id, txt_id, cx, cy, CASE WHEN v > 0 THEN v END AS value FROM (SELECT *, CASE WHEN text LIKE '%cm' THEN n / 100 ELSE n END AS v FROM (SELECT *, replace(regexp_extract(text, '^[0-9]{1,5}([.,][0-9]{1,3})?'), ',', '.')::DOUBLE AS n FROM labels_geo))),
dl AS (SELECT *, degrees(atan2(y2 - y1, x2 - x1)) AS a FROM fp WHERE len >= greatest(sqrt(1000e0 * 1000e0 + 800e0 * 800e0) * 0.07e0, 50)),
dl2 AS (SELECT *, CASE WHEN abs(a) < 10 OR abs(abs(a) - 180) < 10 THEN 'h' WHEN abs(abs(a) - 90) < 10 THEN 'v' END AS orientation FROM dl),
j AS (SELECT l.doc_id, l.seg_id, l.orientation, t.txt_id, t.value, (t.cx - l.cx) * ((l.x2 - l.x1) / l.len) + (t.cy - l.cy) * ((l.y2 - l.y1) / l.len) AS along, (t.cy - l.cy) * ((l.x2 - l.x1) / l.len) - (t.cx - l.cx) * ((l.y2 - l.y1) / l.len) AS across, CASE l.orientation WHEN 'h' THEN abs(l.x2 - l.x1) ELSE abs(l.y2 - l.y1) END AS span FROM dl2 l JOIN val t USING (doc_id) WHERE l.orientation IS NOT NULL AND t.value IS NOT NULL),
lp AS (SELECT *, CASE WHEN across >= 0 THEN 1 ELSE -1 END AS side_of FROM j WHERE abs(across) <= 40),
pairs AS (SELECT doc_id, seg_id, txt_id, side_of, abs(across) AS dist, along, value, orientation, span / value AS ratio FROM lp QUALIFY row_number() OVER (PARTITION BY doc_id, seg_id, side_of ORDER BY abs(across), txt_id) = 1)"""


def _label_pairs(spark: SparkSession, d: str) -> DataFrame:
    diag = (W * W + H * H) ** 0.5
    return labels.label_pairs(labels.dimension_lines(feat(spark, d, "pdf"), diag=diag), labels.valued(derived.labels(spark, d)), max_normal=40.0)


@query(", " + _DIM + " SELECT doc_id, seg_id, txt_id, side_of, round(dist, 5) AS dist, round(along, 5) AS along, round(ratio, 5) AS ratio FROM pairs")
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_label_pairs(spark, d).select("doc_id", "seg_id", "txt_id", "side_of", "dist", "along", "ratio"), "dist", "along", "ratio", digits=5)


@query(", " + _DIM + """, m AS (SELECT doc_id, orientation, median(ratio) AS m, count(*) AS n FROM pairs GROUP BY ALL),
i AS (SELECT p.doc_id, p.orientation, count(*) AS inliers, median(ratio) AS r FROM pairs p JOIN m USING (doc_id, orientation) WHERE abs(ratio - m) <= 0.1e0 * abs(m) GROUP BY ALL)
SELECT m.doc_id, m.orientation, m.n, coalesce(inliers, 0) AS inliers, CASE WHEN inliers >= 3 THEN round(r, 5) END AS scale FROM m LEFT JOIN i USING (doc_id, orientation)""")
def dimscale_robust(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labels.dimension_scale(_label_pairs(spark, d), tol=0.1), "scale", digits=5)


@query(""", t AS (SELECT txt_id, text, regexp_extract(text, '^[0-9]{1,5}([.,][0-9]{1,3})?') AS n, text LIKE '%cm' AS cm FROM labels_geo)
SELECT txt_id, text, CASE WHEN n <> '' AND replace(n, ',', '.')::DOUBLE > 0 THEN round(replace(n, ',', '.')::DOUBLE / CASE WHEN cm THEN 100 ELSE 1 END, 6) END AS value, replace(n, ',', '.')::DOUBLE AS longest, CASE WHEN text LIKE '% cm' THEN 'cm' WHEN text LIKE '% m' THEN 'm' END AS unit FROM t""")
def label_parse(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return rounded(derived.labels(spark, d).select("txt_id", "text", parse.label_value(t).alias("value"), parse.longest_number(t).alias("longest"), parse.loose_unit(t).alias("unit")), "value")


@query(""", t AS (SELECT p_partkey, p_size, (['px', 'pt', 'cm', 'in', '%', 'mm'])[p_partkey % 6 + 1] AS u, (['m', 'cm', 'inch', 'yard', '0.5', 'MM', ' ', 'Decimetre', '-2', NULL])[p_partkey % 10 + 1] AS mu FROM part)
SELECT p_partkey, round(CASE u WHEN '%' THEN 0 ELSE p_size * CASE u WHEN 'px' THEN 1 WHEN 'pt' THEN 96e0 / 72e0 WHEN 'cm' THEN 96e0 / 2.54e0 WHEN 'in' THEN 96 ELSE 96e0 / 25.4e0 END END, 6) AS px, CASE mu WHEN 'm' THEN 1 WHEN 'cm' THEN 0.01e0 WHEN 'inch' THEN 0.0254e0 WHEN '0.5' THEN 0.5e0 WHEN 'MM' THEN 0.001e0 WHEN 'Decimetre' THEN 0.1e0 WHEN 'yard' THEN NULL WHEN '-2' THEN NULL ELSE 1 END AS metres FROM t""")
def unit_factor(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("p_partkey") % len(v)).cast("int"))
    p = derived.read(spark, d, "part")
    return rounded(p.select("p_partkey", parse.length_px(F.concat(F.col("p_size").cast("string"), pick("px", "pt", "cm", "in", "%", "mm"))).alias("px"), parse.unit_metres(pick("m", "cm", "inch", "yard", "0.5", "MM", " ", "Decimetre", "-2", None)).alias("metres")), "px")


@query("SELECT s_suppkey, round(CASE WHEN s_suppkey % 10 <> 0 THEN abs(s_acctbal - (s_suppkey % 10) * 500e0) / abs((s_suppkey % 10) * 500e0) * 100 END, 6) AS gap, coalesce(abs((s_suppkey % 10) * 500e0 - s_acctbal) <= 0.05e0 * greatest(abs((s_suppkey % 10) * 500e0), abs(s_acctbal)), false) AS near, abs(s_acctbal / 5000e0 - 1) > 0.02e0 AS uneven FROM supplier")
def scale_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.col("s_suppkey") % 10) * F.lit(500.0), F.col("s_acctbal")
    return rounded(derived.read(spark, d, "supplier").select("s_suppkey", geom.percent_gap(a, b).alias("gap"), geom.nearly(a, b).alias("near"), (F.abs(b / 5000.0 - 1) > 0.02).alias("uneven")), "gap")


@query("""SELECT vec_id, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, any_value(angle) AS angle, round(max(hi) - min(lo), 5) AS extent, round(max(mo), 5) AS max_off, round(sqrt(avg(off * off)), 5) AS rms_off FROM (
  SELECT *, round(CASE WHEN degrees(theta) < 0 THEN degrees(theta) + 180 ELSE degrees(theta) END, 5) AS angle, abs((x - mx) * sin(theta) - (y - my) * cos(theta)) AS mo, (x - mx) * sin(theta) - (y - my) * cos(theta) AS off, (x - mx) * cos(theta) + (y - my) * sin(theta) AS lo, (x - mx) * cos(theta) + (y - my) * sin(theta) AS hi
  FROM points JOIN (SELECT vec_id, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS theta FROM points GROUP BY vec_id) USING (vec_id)) GROUP BY vec_id""")
def tls_fit(spark: SparkSession, d: str) -> DataFrame:
    f = segments.line_fit(derived.points(spark, d), "vec_id").withColumn("extent", F.col("hi") - F.col("lo"))
    return rounded(rounded(f.select("vec_id", "n", "mx", "my", "angle", "extent", "max_off", "rms_off"), "mx", "my"), "angle", "extent", "max_off", "rms_off", digits=5)


_EDGES = """e AS (SELECT vec_id, i, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
ed AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len, degrees(atan2(y2 - y1, x2 - x1)) AS raw FROM e WHERE x2 IS NOT NULL AND NOT (x1 = x2 AND y1 = y2))"""


@query(", " + _EDGES + """, a AS (SELECT vec_id, CASE WHEN raw < 0 THEN raw + 180 WHEN raw >= 180 THEN raw - 180 ELSE raw END AS a FROM ed),
g AS (SELECT *, lead(a) OVER (PARTITION BY vec_id ORDER BY a) - a AS gap FROM a)
SELECT vec_id, round(180 - greatest(coalesce(max(gap), 0), min(a) + 180 - max(a)), 5) AS spread FROM g GROUP BY vec_id""")
def angle_spread(spark: SparkSession, d: str) -> DataFrame:
    e = segments.edges(derived.points(spark, d), "vec_id")
    return rounded(segments.angle_spread(e, "vec_id"), "spread", digits=5)


@query(", " + _EDGES + """ SELECT a.vec_id, round(max(degrees(acos(greatest(-1e0, least(1e0, (a.x2 - a.x1) / a.len * ((b.x2 - b.x1) / b.len) + (a.y2 - a.y1) / a.len * ((b.y2 - b.y1) / b.len)))))), 4) AS spread FROM ed a JOIN ed b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.vec_id""")
def pair_spread(spark: SparkSession, d: str) -> DataFrame:
    e = segments.edges(derived.points(spark, d), "vec_id")
    return rounded(segments.pair_spread(e, "vec_id"), "spread", digits=4)


@query(", " + _EDGES + " SELECT vec_id, i::INT AS i, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM ed")
def polyline_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.edges(derived.points(spark, d), "vec_id"), "x1", "y1", "x2", "y2")


@query(""", p AS (SELECT seg_id AS id, unnest(range(5)) AS i, x1, y1, x2, y2, n FROM (SELECT *, 0 AS n FROM pdf)),
q AS (SELECT id, i, x1 + (x2 - x1) * (i / 4e0) AS x, y1 + (y2 - y1) * (i / 4e0) + CASE WHEN id % 100 = 0 AND i % 2 = 1 THEN 5e0 ELSE 0e0 END AS y FROM p)
SELECT id, CASE WHEN id % 100 = 0 THEN i ELSE -1 END::INT AS part FROM q WHERE CASE WHEN id % 100 = 0 THEN i < 4 ELSE i = 0 END""")
def straightness(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    p = derived.segments_pdf(spark, d).select(F.col("seg_id").alias("id"), "x1", "y1", "x2", "y2", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    bump = F.when((F.col("id") % 100 == 0) & (i % 2 == 1), 5.0).otherwise(F.lit(0.0))
    p = p.select("id", "i", (F.col("x1") + (F.col("x2") - F.col("x1")) * (i / 4.0)).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * (i / 4.0) + bump).alias("y"))
    return segments.straight(p, "id", max_spread=2.0, max_off=1.0).select("id", "part")


@query(""", r AS (SELECT p_partkey AS id, (p_partkey % 100)::DOUBLE AS x, (p_partkey % 70)::DOUBLE AS y, p_size::DOUBLE AS w, (p_partkey % 4)::DOUBLE AS h FROM part)
SELECT id, unnest([0, 1, 2, 3])::INT AS part, unnest([x, x + w, x + w, x]) AS x1, unnest([y, y, y + h, y + h]) AS y1, unnest([x + w, x + w, x, x]) AS x2, unnest([y, y + h, y + h, y]) AS y2 FROM r WHERE w > 0 AND h > 0""")
def rect_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    r = derived.read(spark, d, "part").select(k.alias("id"), (k % 100).cast("double").alias("x"), (k % 70).cast("double").alias("y"), F.col("p_size").cast("double").alias("w"), (k % 4).cast("double").alias("h"))
    return segments.rect_edges(r, "id")


@query(""", m AS (SELECT *, 90 * (seg_id % 4)::INT AS rot, CASE seg_id % 2 WHEN 0 THEN 1e0 ELSE -1e0 END AS fx FROM pdf),
c AS (SELECT *, CASE rot WHEN 0 THEN 1e0 WHEN 180 THEN -1e0 ELSE 0e0 END AS co, CASE rot WHEN 90 THEN 1e0 WHEN 270 THEN -1e0 ELSE 0e0 END AS si FROM m)
SELECT doc_id, seg_id, round(fx * 1.5e0 * (co * (x1 - 500) - si * (y1 - 400) + 500) + 3, 6) AS fit_x, round(0.5e0 * (si * (x1 - 500) + co * (y1 - 400) + 400) - 2, 6) AS fit_y,
  round(fx * 1.5e0 * (co * x1 - si * y1) + 3, 6) AS match_x, round(0.5e0 * (si * x1 + co * y1) - 2, 6) AS match_y,
  round(fx * (co * 1.5e0 * x1 - si * 0.5e0 * y1) + 3, 6) AS matrix_x, round(si * 1.5e0 * x1 + co * 0.5e0 * y1 - 2, 6) AS matrix_y,
  round(CASE WHEN fx < 0 THEN 1000 - CASE rot WHEN 90 THEN y1 WHEN 180 THEN 1000 - x1 WHEN 270 THEN 1000 - y1 ELSE x1 END ELSE CASE rot WHEN 90 THEN y1 WHEN 180 THEN 1000 - x1 WHEN 270 THEN 1000 - y1 ELSE x1 END END, 6) AS coarse_x,
  round(CASE rot WHEN 90 THEN 800 - x1 WHEN 180 THEN 800 - y1 WHEN 270 THEN x1 ELSE y1 END, 6) AS coarse_y FROM c""")
def transform_conventions(spark: SparkSession, d: str) -> DataFrame:
    s = derived.segments_pdf(spark, d).withColumn("rot", (F.col("seg_id") % 4).cast("int") * 90).withColumn("fx", F.when(F.col("seg_id") % 2 == 0, 1.0).otherwise(F.lit(-1.0)))
    args = [F.col("rot"), F.col("fx"), *map(F.lit, (1.0, 1.5, 0.5, 3.0, -2.0))]
    p = (F.col("x1"), F.col("y1"))
    got = {"fit": geom.fit_affine(*args, F.lit(W), F.lit(H)).point(*p), "match": geom.match_affine(*args).point(*p), "matrix": geom.matrix_affine(*args).point(*p), "coarse": geom.coarse_point(*p, F.col("rot"), F.when(F.col("fx") < 0, "x").otherwise("none"), *map(F.lit, (0.0, 0.0, W, H)))}
    names = [f"{k}_{c}" for k in got for c in "xy"]
    return rounded(s.select("doc_id", "seg_id", *[v.alias(n) for n, v in zip(names, (v for pair in got.values() for v in pair), strict=True)]), *names)


def _canvas(spark: SparkSession, d: str, side: str, size: int = 64) -> DataFrame:
    w, h = (W, H) if side == "pdf" else (SW, SH)
    return raster.draw(feat(spark, d, side), "doc_id", size=size, w=w, h=h)


_DRAW = """u AS (SELECT side, doc_id, x1 / w * 63 AS u1, y1 / h * 63 AS v1, x2 / w * 63 AS u2, y2 / h * 63 AS v2 FROM (SELECT *, CASE side WHEN 'pdf' THEN 1000e0 ELSE 1000e0 * 1.012e0 END AS w, CASE side WHEN 'pdf' THEN 800e0 ELSE 800e0 * 0.993e0 END AS h FROM both_)),
st AS (SELECT *, unnest(range(0, n::BIGINT + 1)) AS k FROM (SELECT *, greatest(ceil(greatest(abs(u2 - u1), abs(v2 - v1))), 1) AS n FROM u)),
px AS (SELECT DISTINCT side, doc_id, round_even(v1 + (v2 - v1) * (k / n), 0)::BIGINT AS row, round_even(u1 + (u2 - u1) * (k / n), 0)::BIGINT AS col FROM st),
px64 AS (SELECT * FROM px WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63)"""


@query(", " + _DRAW + " SELECT doc_id, row, col FROM px64 WHERE side = 'pdf'")
def raster_dda(spark: SparkSession, d: str) -> DataFrame:
    return _canvas(spark, d, "pdf")


@query(", " + _DRAW + """, sh AS (SELECT * FROM (VALUES (0, 0), (1, 0), (0, 1), (-1, 2)) t(dr, dc))
SELECT a.doc_id, dr::INT AS dr, dc::INT AS dc, count(*) AS common, count(*) / 4096e0 AS share FROM px64 b, sh, px64 a WHERE b.side = 'svg' AND a.side = 'pdf' AND a.doc_id = b.doc_id AND a.row = (b.row + dr + 64) % 64 AND a.col = (b.col + dc + 64) % 64 GROUP BY ALL""")
def raster_overlap(spark: SparkSession, d: str) -> DataFrame:
    ids = derived.pages(spark, d).select("doc_id").distinct()
    shifts = ids.crossJoin(F.broadcast(spark.createDataFrame([(0, 0), (1, 0), (0, 1), (-1, 2)], "dr int, dc int")))
    return raster.overlap(_canvas(spark, d, "pdf"), _canvas(spark, d, "svg"), 64, shifts)


@query(", " + _DRAW + """, s AS (SELECT doc_id, round_even(least(greatest(px / 1000e0 * 63, 0), 63), 0) AS u, round_even(least(greatest(py / 800e0 * 63, 0), 63), 0) AS v FROM (SELECT doc_id, x1 + (x2 - x1) * (i / 17e0) AS px, y1 + (y2 - y1) * (i / 17e0) AS py FROM (SELECT *, unnest(range(1, 17)) AS i FROM fp))),
k AS (SELECT DISTINCT * FROM s), m AS (SELECT k.doc_id, u, v, least(1.5e0, coalesce(min(sqrt((u - col) * (u - col) + (v - row) * (v - row))), 1.5e0)) AS d FROM k LEFT JOIN (SELECT * FROM px64 WHERE side = 'svg') p ON k.doc_id = p.doc_id AND abs(u - col) <= 1 AND abs(v - row) <= 1 GROUP BY ALL)
SELECT doc_id, count(*) AS n, round(sqrt(avg(d * d)), 6) AS rmse, round(1 / (1 + sqrt(avg(d * d))), 6) AS score, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.5), 6) AS median FROM s JOIN m USING (doc_id, u, v) GROUP BY doc_id""")
def distmap_qa(spark: SparkSession, d: str) -> DataFrame:
    s = segments.sample_inside(feat(spark, d, "pdf")).select("doc_id", "px", "py")
    svg = feat(spark, d, "svg").select("doc_id", *[(F.col(c) * (W / SW if c[0] == "x" else H / SH)).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return rounded(raster.distance_quality(svg, s, size=64, w=W, h=H, hard=1.5), "rmse", "p95", "median", "score")


@query("""SELECT doc_id, 'H' AS dir, row AS line, min(col) AS lo, max(col) AS hi FROM (SELECT *, col - row_number() OVER (PARTITION BY doc_id, row ORDER BY col) AS k FROM pixels WHERE val > 50) GROUP BY doc_id, row, k HAVING min(col) < max(col)
UNION ALL SELECT doc_id, 'V', col, min(row), max(row) FROM (SELECT *, row - row_number() OVER (PARTITION BY doc_id, col ORDER BY row) AS k FROM pixels WHERE val > 50) GROUP BY doc_id, col, k HAVING min(row) < max(row)""")
def runlength_segments(spark: SparkSession, d: str) -> DataFrame:
    p = derived.pixels(spark, d).where("val > 50")
    return raster.runs(p, "row").unionByName(raster.runs(p, "col"))


_GRAD = """g0 AS (SELECT *, lag(val) OVER r AS w0, lead(val) OVER r AS w1, lag(val) OVER c AS n0, lead(val) OVER c AS n1 FROM pixels WINDOW r AS (PARTITION BY doc_id, row ORDER BY col), c AS (PARTITION BY doc_id, col ORDER BY row)),
g AS (SELECT doc_id, row, col, sqrt(pow(CASE WHEN w0 IS NULL AND w1 IS NULL THEN 0 WHEN w0 IS NULL THEN w1 - val WHEN w1 IS NULL THEN val - w0 ELSE (w1 - w0) / 2 END, 2) + pow(CASE WHEN n0 IS NULL AND n1 IS NULL THEN 0 WHEN n0 IS NULL THEN n1 - val WHEN n1 IS NULL THEN val - n0 ELSE (n1 - n0) / 2 END, 2)) AS g FROM g0)"""


@query(", " + _GRAD + " SELECT doc_id, row, col, round(g, 6) AS g FROM g")
def pixel_gradient(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.gradient(derived.pixels(spark, d)).select("doc_id", "row", "col", "g"), "g")


@query(", " + _GRAD + """, e AS (SELECT doc_id, row, col FROM g JOIN (SELECT doc_id, greatest(quantile_cont(g, 0.6), 10) AS cut FROM g GROUP BY doc_id) USING (doc_id) WHERE g > cut),
r AS (SELECT doc_id, 'H' AS dir, row AS line, min(col) AS lo, max(col) AS hi FROM (SELECT *, col - row_number() OVER (PARTITION BY doc_id, row ORDER BY col) AS k FROM e) GROUP BY doc_id, row, k HAVING min(col) < max(col)
  UNION ALL SELECT doc_id, 'V', col, min(row), max(row) FROM (SELECT *, row - row_number() OVER (PARTITION BY doc_id, col ORDER BY row) AS k FROM e) GROUP BY doc_id, col, k HAVING min(row) < max(row)),
s AS (SELECT doc_id, CASE dir WHEN 'H' THEN (lo + 0.5e0) / 4 ELSE (line + 0.5e0) / 4 END AS x1, CASE dir WHEN 'H' THEN 20 - (line + 0.5e0) / 4 ELSE 20 - (lo + 0.5e0) / 4 END AS y1, CASE dir WHEN 'H' THEN (hi + 0.5e0) / 4 ELSE (line + 0.5e0) / 4 END AS x2, CASE dir WHEN 'H' THEN 20 - (line + 0.5e0) / 4 ELSE 20 - (hi + 0.5e0) / 4 END AS y2 FROM r)
SELECT * FROM s WHERE pow(x2 - x1, 2) + pow(y2 - y1, 2) >= 0.25e0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pow(x2 - x1, 2) + pow(y2 - y1, 2) DESC, x1, y1, x2, y2) <= 100""")
def raster_edge_scan(spark: SparkSession, d: str) -> DataFrame:
    return raster.edge_segments(derived.pixels(spark, d), zoom=4.0, page_h=20.0, quantile=0.6, least=0.5, most=100).select("doc_id", "x1", "y1", "x2", "y2")


@query(""", t AS (SELECT doc_id, 1 AS o, 39 - row AS r, col AS c, val FROM pixels UNION ALL SELECT doc_id, 2, (SELECT max(col) FROM pixels) - col, row, val FROM pixels)
SELECT doc_id, o::INT AS o, r AS row, c AS col, val FROM t""")
def raster_turns(spark: SparkSession, d: str) -> DataFrame:
    p = derived.pixels(spark, d)
    wide = (p.agg(F.max("col")).first()[0] or 0) + 1
    flip, rot = raster.turn(p, 40, wide, flip="y"), raster.turn(p, 40, wide, rot=90)
    return flip.withColumn("o", F.lit(1)).unionByName(rot.withColumn("o", F.lit(2))).select("doc_id", "o", "row", "col", "val")


@query("SELECT doc_id, row + 3 AS row, col - 5 AS col, CASE WHEN max(val) OVER (PARTITION BY doc_id) > 1 THEN val / 255e0 ELSE val END AS val FROM pixels QUALIFY row + 3 BETWEEN 0 AND 29 AND col - 5 BETWEEN 0 AND 19")
def raster_place(spark: SparkSession, d: str) -> DataFrame:
    return raster.place(raster.normalised(derived.pixels(spark, d)), 3, -5, 30, 20).select("doc_id", "row", "col", "val")


@query("""SELECT a.doc_id, count(*) AS n, round(CASE WHEN stddev_pop(a.val) <= 1e-9 OR stddev_pop(b.val) <= 1e-9 THEN 0 ELSE corr(a.val, b.val) END, 6) AS ncc FROM pixels a JOIN pixels b ON a.doc_id = b.doc_id AND a.row = b.row AND a.col = b.col + 1 GROUP BY a.doc_id""")
def ncc_scale(spark: SparkSession, d: str) -> DataFrame:
    p = derived.pixels(spark, d)
    b = p.select("doc_id", "row", (F.col("col") + 1).alias("col"), F.col("val").alias("b"))
    return rounded(raster.ncc(p.withColumnRenamed("val", "a").join(b, ["doc_id", "row", "col"]), "doc_id"), "ncc")


@query("""SELECT doc_id, 0 AS rot, true AS flip_y, round(1000e0 * 1.012e0 / 1000e0, 9) AS sx, round(800e0 * 0.993e0 / 800e0, 9) AS sy, 'high' AS confidence, 'pagebox:high' AS source FROM (SELECT DISTINCT doc_id FROM pdf)""")
def pagebox_align(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hypotheses.page_alignment(derived.pages(spark, d)), "sx", "sy", digits=9)


@query("""SELECT doc_id, round(greatest(sqrt(1640000e0) * 0.002e0, 0.5e0), 6) AS tol, round(sqrt(doc_id * doc_id + 2.25e0), 6) AS shift, round((1.5e0 + 0.5e0) / 2, 6) AS scale, doc_id % 2 = 1 AS mirrored, sqrt(doc_id * doc_id + 2.25e0) <= greatest(sqrt(1640000e0) * 0.002e0, 0.5e0) AS aligned, CASE doc_id % 2 WHEN 1 THEN 'X' ELSE 'none' END AS flip FROM (SELECT DISTINCT doc_id FROM pdf)""")
def alignment_diag(spark: SparkSession, d: str) -> DataFrame:
    pages = derived.pages(spark, d)
    m = pages.where("side = 'pdf'").select("doc_id", F.when(F.col("doc_id") % 2 == 1, -1).otherwise(1).alias("fx"), F.lit(1).alias("fy"), F.lit(1.5).alias("sx"), F.lit(0.5).alias("sy"), F.col("doc_id").cast("double").alias("tx"), F.lit(1.5).alias("ty"))
    return rounded(hypotheses.diagnostics(m, pages), "tol", "shift", "scale")


_ORIENT = """hyp AS (SELECT * FROM (VALUES (0, 0, 1, 1), (1, 0, -1, 1), (2, 0, 1, -1), (3, 0, -1, -1), (4, 180, 1, 1), (5, 180, -1, 1), (6, 180, 1, -1), (7, 180, -1, -1)) h(hyp_id, rot, fx, fy)),
mv0 AS (SELECT doc_id, hyp_id, (fx < 0) <> (rot = 180) AS mx, (fy < 0) <> (rot = 180) AS my, x1, y1, x2, y2 FROM pdf, hyp),
mv AS (SELECT doc_id, hyp_id, CASE WHEN mx THEN 1000 - x1 ELSE x1 END AS x1, CASE WHEN my THEN 800 - y1 ELSE y1 END AS y1, CASE WHEN mx THEN 1000 - x2 ELSE x2 END AS x2, CASE WHEN my THEN 800 - y2 ELSE y2 END AS y2 FROM mv0),
un AS (SELECT doc_id, x1 * (1000e0 / 1012e0) AS x1, y1 * (800e0 / 794.4e0) AS y1, x2 * (1000e0 / 1012e0) AS x2, y2 * (800e0 / 794.4e0) AS y2 FROM svg),
ca AS (SELECT doc_id, hyp_id, profile, least(floor(t * 40), 39)::INT AS bin, count(*) AS n FROM (SELECT doc_id, hyp_id, 'x' AS profile, (x1 + x2) / 2 / 1000e0 AS t FROM mv UNION ALL SELECT doc_id, hyp_id, 'y', (y1 + y2) / 2 / 800e0 FROM mv) WHERE t >= 0 AND t <= 1 GROUP BY ALL),
cb AS (SELECT doc_id, profile, least(floor(t * 40), 39)::INT AS bin, count(*) AS n FROM (SELECT doc_id, 'x' AS profile, (x1 + x2) / 2 / 1000e0 AS t FROM un UNION ALL SELECT doc_id, 'y', (y1 + y2) / 2 / 800e0 FROM un) WHERE t >= 0 AND t <= 1 GROUP BY ALL),
da AS (SELECT k.doc_id, k.hyp_id, k.profile, b.bin, coalesce(ca.n, 0) - k.m AS v FROM (SELECT doc_id, hyp_id, profile, sum(n) / 40e0 AS m FROM ca GROUP BY ALL) k, (SELECT unnest(range(40)) AS bin) b LEFT JOIN ca ON ca.doc_id = k.doc_id AND ca.hyp_id = k.hyp_id AND ca.profile = k.profile AND ca.bin = b.bin),
db AS (SELECT k.doc_id, k.profile, b.bin, coalesce(cb.n, 0) - k.m AS v FROM (SELECT doc_id, profile, sum(n) / 40e0 AS m FROM cb GROUP BY ALL) k, (SELECT unnest(range(40)) AS bin) b LEFT JOIN cb ON cb.doc_id = k.doc_id AND cb.profile = k.profile AND cb.bin = b.bin),
na AS (SELECT doc_id, hyp_id, profile, sqrt(sum(v * v)) AS n FROM da GROUP BY ALL), nb AS (SELECT doc_id, profile, sqrt(sum(v * v)) AS n FROM db GROUP BY ALL),
cc AS (SELECT a.doc_id, a.hyp_id, a.profile, b.bin - a.bin AS shift, sum(a.v * b.v) AS s FROM da a JOIN db b USING (doc_id, profile) GROUP BY ALL),
cn AS (SELECT cc.doc_id, cc.hyp_id, cc.profile, shift, round(s / greatest(na.n * nb.n, 1e-12), 9) AS c FROM cc JOIN na USING (doc_id, hyp_id, profile) JOIN nb USING (doc_id, profile)),
pk AS (SELECT * FROM cn QUALIFY row_number() OVER (PARTITION BY doc_id, hyp_id, profile ORDER BY c DESC, shift) = 1),
sh AS (SELECT doc_id, hyp_id, max(shift) FILTER (profile = 'x') * 25e0 AS dx, max(shift) FILTER (profile = 'y') * 20e0 AS dy, (max(c) FILTER (profile = 'x') + max(c) FILTER (profile = 'y')) / 2 AS response FROM pk GROUP BY ALL),
pm AS (SELECT DISTINCT doc_id, hyp_id, round_even(v1 + (v2 - v1) * (k / n), 0)::BIGINT AS row, round_even(u1 + (u2 - u1) * (k / n), 0)::BIGINT AS col FROM (SELECT *, unnest(range(0, n::BIGINT + 1)) AS k FROM (SELECT doc_id, hyp_id, x1 / 1000e0 * 63 AS u1, y1 / 800e0 * 63 AS v1, x2 / 1000e0 * 63 AS u2, y2 / 800e0 * 63 AS v2, greatest(ceil(greatest(abs(x2 / 1000e0 * 63 - x1 / 1000e0 * 63), abs(y2 / 800e0 * 63 - y1 / 800e0 * 63))), 1) AS n FROM mv))),
ps AS (SELECT DISTINCT doc_id, round_even(v1 + (v2 - v1) * (k / n), 0)::BIGINT AS row, round_even(u1 + (u2 - u1) * (k / n), 0)::BIGINT AS col FROM (SELECT *, unnest(range(0, n::BIGINT + 1)) AS k FROM (SELECT doc_id, x1 / 1000e0 * 63 AS u1, y1 / 800e0 * 63 AS v1, x2 / 1000e0 * 63 AS u2, y2 / 800e0 * 63 AS v2, greatest(ceil(greatest(abs(x2 / 1000e0 * 63 - x1 / 1000e0 * 63), abs(y2 / 800e0 * 63 - y1 / 800e0 * 63))), 1) AS n FROM un))),
ov AS (SELECT m.doc_id, m.hyp_id, count(*) AS common FROM (SELECT pm.doc_id, pm.hyp_id, ((row + round_even(dy / 800e0 * 63, 0)::INT) % 64 + 64) % 64 AS row, ((col + round_even(dx / 1000e0 * 63, 0)::INT) % 64 + 64) % 64 AS col FROM pm JOIN sh USING (doc_id, hyp_id) WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63) m
  JOIN (SELECT * FROM ps WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63) s USING (doc_id, row, col) GROUP BY ALL),
orient AS (SELECT sh.doc_id, hyp_id, rot, fx, fy, dx, dy, response, coalesce(common, 0) / 4096e0 AS overlap, coalesce(common, 0) / 4096e0 - 0.25e0 * (abs(dx) / 1000e0 + abs(dy) / 800e0) AS key FROM sh LEFT JOIN ov USING (doc_id, hyp_id) JOIN hyp USING (hyp_id))"""


def _orient(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses.orientation(derived.segments_pdf(spark, d), derived.segments_svg(spark, d), hypotheses.flips(spark), w=W, h=H, svg_w=SW, svg_h=SH)


@query(", " + _ORIENT + " SELECT doc_id, hyp_id, rot, fx, fy, round(dx, 6) AS dx, round(dy, 6) AS dy, round(response, 6) AS response, round(overlap, 6) AS overlap, round(key, 6) AS key FROM orient")
def orientation_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_orient(spark, d), "dx", "dy", "response", "overlap", "key")


@query(", " + _ORIENT + " SELECT doc_id, hyp_id, rot, fx, fy, round(dx, 6) AS dx, round(dy, 6) AS dy FROM orient QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(key, 9) DESC, round(response, 9) DESC, hyp_id) = 1")
def orientation_best(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hypotheses.best(_orient(spark, d), "key", "response").select("doc_id", "hyp_id", "rot", "fx", "fy", "dx", "dy"), "dx", "dy")


_COARSE = """hyp AS (SELECT * FROM (VALUES (0, 0, 'none'), (1, 0, 'x'), (2, 0, 'y'), (3, 90, 'none'), (4, 90, 'x'), (5, 90, 'y'), (6, 180, 'none'), (7, 180, 'x'), (8, 180, 'y'), (9, 270, 'none'), (10, 270, 'x'), (11, 270, 'y')) h(hyp_id, rot, flip)),
b AS (SELECT 4.2e0 AS x0, -5.6e0 AS y0, 1000e0 * 1.012e0 AS w, 800e0 * 0.993e0 AS h),
t0 AS (SELECT doc_id, seg_id, len, hyp_id, flip, x0, y0, w, h, CASE rot WHEN 90 THEN y1 - y0 WHEN 180 THEN w - (x1 - x0) WHEN 270 THEN w - (y1 - y0) ELSE x1 - x0 END AS p1, CASE rot WHEN 90 THEN h - (x1 - x0) WHEN 180 THEN h - (y1 - y0) WHEN 270 THEN x1 - x0 ELSE y1 - y0 END AS q1,
  CASE rot WHEN 90 THEN cy - y0 WHEN 180 THEN w - (cx - x0) WHEN 270 THEN w - (cy - y0) ELSE cx - x0 END AS pm, CASE rot WHEN 90 THEN h - (cx - x0) WHEN 180 THEN h - (cy - y0) WHEN 270 THEN cx - x0 ELSE cy - y0 END AS qm,
  CASE rot WHEN 90 THEN y2 - y0 WHEN 180 THEN w - (x2 - x0) WHEN 270 THEN w - (y2 - y0) ELSE x2 - x0 END AS p2, CASE rot WHEN 90 THEN h - (x2 - x0) WHEN 180 THEN h - (y2 - y0) WHEN 270 THEN x2 - x0 ELSE y2 - y0 END AS q2 FROM fs, hyp, b),
t1 AS (SELECT doc_id, seg_id, len, hyp_id, x0, y0, w, h, CASE flip WHEN 'x' THEN w - pm ELSE pm END + x0 AS mx, CASE flip WHEN 'y' THEN h - qm ELSE qm END + y0 AS my, CASE flip WHEN 'x' THEN w - p1 ELSE p1 END + x0 AS x1, CASE flip WHEN 'y' THEN h - q1 ELSE q1 END + y0 AS y1, CASE flip WHEN 'x' THEN w - p2 ELSE p2 END + x0 AS x2, CASE flip WHEN 'y' THEN h - q2 ELSE q2 END + y0 AS y2 FROM t0),
t2 AS (SELECT *, degrees(atan2(y2 - y1, x2 - x1)) AS raw FROM t1), t3 AS (SELECT *, CASE WHEN raw < 0 THEN raw + 180 WHEN raw >= 180 THEN raw - 180 ELSE raw END AS ang FROM t2),
lv AS (SELECT *, si * 2 + ti AS level FROM (VALUES (0, 0.1e0), (1, 0.4e0), (2, 1e0)) a(si, share), (VALUES (0, 0.3e0), (1, 2e0)) b(ti, tol)),
rp AS (SELECT doc_id, seg_id, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, seg_id) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM fp),
rs AS (SELECT doc_id, seg_id, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, seg_id) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM fs),
lp0 AS (SELECT level, doc_id, seg_id, tol FROM rp, lv WHERE r <= greatest(1, floor(n * share))), ls0 AS (SELECT level, doc_id, seg_id, tol FROM rs, lv WHERE r <= greatest(1, floor(n * share))),
enough AS (SELECT doc_id, level FROM (SELECT doc_id, level, count(*) AS a FROM lp0 GROUP BY ALL) JOIN (SELECT doc_id, level, count(*) AS b FROM ls0 GROUP BY ALL) USING (doc_id, level) WHERE least(a, b) >= 4),
mv AS (SELECT * FROM t3), lm AS (SELECT m.*, level, CASE WHEN least(ang, 180 - ang) <= tol AND least(ang, 180 - ang) <= abs(ang - 90) THEN 'H' WHEN abs(ang - 90) <= tol THEN 'V' END AS axis FROM t3 m JOIN ls0 USING (doc_id, seg_id)),
lf AS (SELECT f.* EXCLUDE (axis), level, CASE WHEN least(ang, 180 - ang) <= tol AND least(ang, 180 - ang) <= abs(ang - 90) THEN 'H' WHEN abs(ang - 90) <= tol THEN 'V' END AS axis FROM fp f JOIN lp0 USING (doc_id, seg_id)),
pa AS (SELECT doc_id, level, CASE axis WHEN 'H' THEN 'X' ELSE 'Y' END AS profile, least(floor(greatest(0e0, least(1e0, CASE axis WHEN 'H' THEN (cx - 0e0) / 1000e0 ELSE (cy - 0e0) / 800e0 END)) * 64), 63)::INT AS bin, sum(len) AS w FROM lf WHERE axis IS NOT NULL GROUP BY ALL),
pb AS (SELECT doc_id, level, hyp_id, CASE axis WHEN 'H' THEN 'X' ELSE 'Y' END AS profile, least(floor(greatest(0e0, least(1e0, CASE axis WHEN 'H' THEN (mx - x0) / w ELSE (my - y0) / h END)) * 64), 63)::INT AS bin, sum(len) AS w FROM lm WHERE axis IS NOT NULL GROUP BY ALL),
na AS (SELECT doc_id, level, profile, sqrt(sum(w * w)) AS n FROM pa GROUP BY ALL), nb AS (SELECT doc_id, level, hyp_id, profile, sqrt(sum(w * w)) AS n FROM pb GROUP BY ALL),
cc AS (SELECT pb.doc_id, pb.level, pb.hyp_id, pb.profile, pa.bin - pb.bin AS shift, sum(pa.w * pb.w) AS s FROM pa JOIN pb USING (doc_id, level, profile) GROUP BY ALL),
pk AS (SELECT cc.doc_id, cc.level, cc.hyp_id, cc.profile, shift, round(s / (na.n * nb.n), 9) AS c FROM cc JOIN na USING (doc_id, level, profile) JOIN nb USING (doc_id, level, hyp_id, profile) QUALIFY row_number() OVER (PARTITION BY cc.doc_id, cc.level, cc.hyp_id, cc.profile ORDER BY round(s / (na.n * nb.n), 9) DESC, CASE WHEN shift >= 0 THEN shift ELSE shift + 1000000 END) = 1),
top AS (SELECT doc_id, level, hyp_id, coalesce(max(c) FILTER (profile = 'X'), 0) AS cx, coalesce(max(c) FILTER (profile = 'Y'), 0) AS cy, coalesce(max(shift) FILTER (profile = 'X'), 0) * (1000e0 / 64) AS dx, coalesce(max(shift) FILTER (profile = 'Y'), 0) * (800e0 / 64) AS dy FROM pk JOIN enough USING (doc_id, level) GROUP BY ALL),
sp AS (SELECT DISTINCT doc_id, hyp_id, dx, dy FROM top),
sc AS (SELECT m.doc_id, m.hyp_id, dx, dy, (mx - x0) * (1000e0 / w) + 0e0 + dx AS lx, (my - y0) * (800e0 / h) + 0e0 + dy AS ly, sqrt(pow((x2 - x1) * (1000e0 / w), 2) + pow((y2 - y1) * (800e0 / h), 2)) AS s_len, degrees(atan2(y2 * (800e0 / h) - y1 * (800e0 / h), x2 * (1000e0 / w) - x1 * (1000e0 / w))) AS sa FROM mv m JOIN sp USING (doc_id, hyp_id)),
nr AS (SELECT s.doc_id, s.hyp_id, dx, dy, sum(least(p.len, s_len)) AS near FROM sc s JOIN fp p USING (doc_id) WHERE sqrt((lx - p.cx) * (lx - p.cx) + (ly - p.cy) * (ly - p.cy)) <= 12 AND s_len / p.len BETWEEN 0.85e0 AND 1.15e0 AND least(abs(p.ang - (sa + 360) % 180), 180 - abs(p.ang - (sa + 360) % 180)) <= 6 GROUP BY ALL),
tt AS (SELECT doc_id, hyp_id, dx, dy, sum(s_len) AS total FROM sc GROUP BY ALL),
coarse AS (SELECT doc_id, level, hyp_id, rot, flip, cx, cy, dx, dy, coalesce(near, 0) / total AS inliers, 0.4e0 * cx + 0.4e0 * cy + 0.2e0 * (coalesce(near, 0) / total) AS score FROM top JOIN hyp USING (hyp_id) JOIN tt USING (doc_id, hyp_id, dx, dy) LEFT JOIN nr USING (doc_id, hyp_id, dx, dy))"""


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses.coarse(feat(spark, d, "pdf"), feat(spark, d, "svg"), hypotheses.turns(spark), (0.0, 0.0, W, H), (derived.TX, derived.TY, SW, SH), shares=(0.1, 0.4, 1.0), tols=(0.3, 2.0))


@query(", " + _COARSE + " SELECT doc_id, level, hyp_id, rot, flip, round(cx, 6) AS cx, round(cy, 6) AS cy, round(dx, 6) AS dx, round(dy, 6) AS dy, round(inliers, 5) AS inliers, round(score, 5) AS score FROM coarse")
def coarse_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    c = _coarse(spark, d).drop("sx", "sy")
    return rounded(rounded(c, "cx", "cy", "dx", "dy"), "inliers", "score", digits=5)


@query(", " + _COARSE + " SELECT doc_id, level, hyp_id, rot, flip, round(dx, 6) AS dx, round(dy, 6) AS dy FROM coarse QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, level, hyp_id) = 1")
def coarse_best(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hypotheses.best(_coarse(spark, d), "score").select("doc_id", "level", "hyp_id", "rot", "flip", "dx", "dy"), "dx", "dy")


@query("SELECT page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<p[ >]'))::INT AS paragraphs, regexp_matches(html, '<(text|tspan|flowRoot|flowPara)[\\s>/]') AS has_text FROM pages")
def attr_scan_pages(spark: SparkSession, d: str) -> DataFrame:
    p = derived.read(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<p[ >]")).alias("paragraphs"), parse.has_text(F.col("html")).alias("has_text"))


@query(""", t AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 13)::DOUBLE AS b FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size::DOUBLE * 2 END AS vb_w, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 7e0 END AS vb_h, 2 + (p_partkey % 2)::INT AS n_points, a + b AS point_sum, 3 AS floats FROM part JOIN t USING (p_partkey)""")
def attribute_parse(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    box = F.when(k % 4 == 3, F.lit('<svg viewBox="0 0 -1 7">')).otherwise(F.format_string('<svg viewBox="0, 0 %d 7">', F.col("p_size") * 2))
    pts = F.concat(s, F.lit(","), (k % 13).cast("string"), F.lit(" 1 2"), F.when(k % 2 == 1, " 3,4 9").otherwise(F.lit(" 5")))
    p = derived.read(spark, d, "part").select("p_partkey", parse.view_box(box).alias("v"), parse.points(pts).alias("q"), parse.bare_floats(F.concat(F.lit("M"), s, F.lit(" 1.5L2"))).alias("f"))
    return p.select("p_partkey", F.col("v.w").alias("vb_w"), F.col("v.h").alias("vb_h"), F.size("q").alias("n_points"), (F.get("q", F.lit(0))["x"] + F.get("q", F.lit(0))["y"]).alias("point_sum"), F.size("f").alias("floats"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_id) - 1 AS seg_id, round(x1 * 2 + 10, 6) AS x1, round(y1 * 2 - 3, 6) AS y1, round(x2 * 2 + 10, 6) AS x2, round(y2 * 2 - 3, 6) AS y2 FROM svg")
def svg_scan(spark: SparkSession, d: str) -> DataFrame:
    """Drawings are written from segments, under a transform, and scanned back."""
    s = derived.segments_svg(spark, d)
    line = F.format_string('<line x1="%s" y1="%s" x2="%s" y2="%s"/>', *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")])
    path = F.format_string('<path d="M%s %s L%s,%s"/>', *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")])
    e = s.select("doc_id", "seg_id", F.when(F.col("seg_id") % 2 == 0, line).otherwise(path).alias("e"))
    docs = e.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", "e"))).alias("a"))
    text = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="3000" height="2000"><g transform="translate(10,-3) scale(2)">'), F.array_join(F.transform("a", lambda x: x["e"]), ""), F.lit("</g></svg>"))
    return rounded(svg.segments(docs.select("doc_id", text.alias("svg"))), "x1", "y1", "x2", "y2")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    p = derived.pages(spark, d).groupBy("doc_id").pivot("side", ["pdf", "svg"]).agg(F.first("w").alias("w"), F.first("h").alias("h"))
    return p.select("doc_id", (F.col("svg_w") / F.col("pdf_w")).alias("sx0"), (F.col("svg_h") / F.col("pdf_h")).alias("sy0"), F.lit(0.0).alias("tx0"), F.lit(0.0).alias("ty0"))


def _model(spark: SparkSession, d: str) -> DataFrame:
    return fit.fit(feat(spark, d, "pdf"), feat(spark, d, "svg"), _seeds(spark, d))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return derived.pages(spark, d).select("doc_id").distinct().select("doc_id", F.lit(1).alias("fx"), F.lit(1).alias("fy"), *[F.lit(v).alias(k) for k, v in (("sx", derived.SX), ("sy", derived.SY), ("tx", derived.TX), ("ty", derived.TY))])


@query()
def ransac_fit(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d)


@query("SELECT DISTINCT doc_id, true AS scale_ok, true AS shift_ok, true AS sure FROM pdf")
def fit_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The fit against the map by which the drawings were made: scales to 1 %, shifts to 4 pixels."""
    scale = (F.abs(F.col("sx") / derived.SX - 1) <= 0.01) & (F.abs(F.col("sy") / derived.SY - 1) <= 0.01)
    shift = (F.abs(F.col("tx") - derived.TX) <= 4) & (F.abs(F.col("ty") - derived.TY) <= 4)
    return _model(spark, d).select("doc_id", scale.alias("scale_ok"), shift.alias("shift_ok"), ((F.col("score") > 0.5) & (F.size("quality_notes") == 0)).alias("sure"))


@query("SELECT DISTINCT doc_id, 5::BIGINT AS lines, 5::BIGINT AS matched, 5::BIGINT AS passed FROM pdf")
def match_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Under the true map every chosen line's match is the segment that was made from it."""
    return _matches(spark, d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("s_id") == F.col("seg_id")).alias("matched"), F.count_if(F.col("pass01") == 1).alias("passed"))


@query()
def select_lines(spark: SparkSession, d: str) -> DataFrame:
    return match.select_lines(feat(spark, d, "pdf"), feat(spark, d, "svg"), _truth(spark, d)).select("doc_id", "pick", "seg_id", "axis", "len", "notes")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    svg_ = feat(spark, d, "svg")
    return match.match_lines(match.select_lines(feat(spark, d, "pdf"), svg_, _truth(spark, d)), svg_)


@query()
def match_lines(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


@query()
def match_report(spark: SparkSession, d: str) -> DataFrame:
    return match.report(_matches(spark, d), _truth(spark, d), derived.pages(spark, d))


@query(""", m AS (SELECT doc_id, seg_id, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, seg_id) AS id, axis, len FROM fp WHERE axis IS NOT NULL QUALIFY id <= 4),
s AS (SELECT doc_id, id FROM (SELECT DISTINCT doc_id FROM pdf), (SELECT unnest([1, 2, 3, 4, 5]) AS id)),
v AS (SELECT s.doc_id, s.id, axis, len, seg_id, CASE WHEN seg_id % 10 <> 0 THEN len * 1.02e0 END AS sl, CASE axis WHEN 'H' THEN 1.012e0 WHEN 'V' THEN 0.993e0 END AS e FROM s LEFT JOIN m USING (doc_id, id))
SELECT doc_id, 'doc_' || doc_id AS pdf_file, '0' AS page_index, '0' AS rot_deg, '1.01200' AS sx, '0.99300' AS sy, '4.200' AS tx, '-5.600' AS ty, '' AS score, '' AS rmse, '' AS p95, '' AS median, '' AS calibration_notes, 'none' AS flip_xy,
  '7.000' AS shift_abs, printf('%.3f', sqrt(1012e0 * 1012e0 + 794.4e0 * 794.4e0) * 0.002e0) AS shift_tol_px, 'auto (0.2% diag, ≥0.5px)' AS shift_tol_source, '' AS scale_tol_rel, 'Bounds: trans≤' || printf('%.3f', sqrt(1012e0 * 1012e0 + 794.4e0 * 794.4e0) * 0.002e0) || 'px (auto)' AS bounds,
  id::VARCHAR AS id, coalesce(axis, '') AS axis, coalesce(printf('%.3f', len), '') AS pdf_len, coalesce(printf('%.3f', sl), '') AS svg_len, coalesce(printf('%.4f', sl / len), '') AS ratio, coalesce(printf('%.4f', e), '') AS axis_scale_expected, coalesce(printf('%.4f', abs(sl / len - e) / e), '') AS rel_error,
  CASE WHEN sl IS NULL THEN '' WHEN axis = 'H' THEN '1' ELSE '0' END AS pass01, CASE WHEN seg_id IS NULL THEN '' WHEN sl IS NULL THEN '0.000' WHEN seg_id % 3 = 0 THEN '0.250' ELSE '0.900' END AS confidence,
  CASE WHEN seg_id IS NULL THEN 'missing match entry' WHEN sl IS NULL THEN 'no match' WHEN seg_id % 3 = 0 THEN 'low confidence' ELSE '' END AS notes FROM v""")
def report_slots(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the report over made-up matches: four of five slots, some of them unmatched or unsure."""
    f = segments.top_absolute(feat(spark, d, "pdf").where("axis is not null"), 4, "doc_id")
    hit, k = F.col("seg_id") % 10 != 0, F.col("seg_id")
    sure = F.when(~hit, 0.0).when(k % 3 == 0, 0.25).otherwise(0.9)
    m = f.select("doc_id", F.col("rank").cast("int").alias("pick"), "axis", "seg_id", F.when(hit, k).alias("s_id"), F.when(hit, 0.5).alias("cost"), sure.alias("confidence"), F.col("len").alias("pdf_len"), F.when(hit, F.col("len") * 1.02).alias("svg_len"), F.lit(None).cast("double").alias("rel_error"), F.when(hit, (F.col("axis") == "H").cast("int")).alias("pass01"))
    return match.report(m, _truth(spark, d), derived.pages(spark, d))


@query("SELECT DISTINCT doc_id, 2 AS du, -3 AS dv, true AS sure FROM pdf")
def phase_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Phase correlation of a canvas with itself rolled by (3, -2)."""
    p = _canvas(spark, d, "pdf").withColumn("val", F.lit(1.0))
    rolled = p.withColumns({"row": F.pmod(F.col("row") + 3, F.lit(64)), "col": F.pmod(F.col("col") - 2, F.lit(64))})
    found = raster.phase_shifts(p.withColumn("side", F.lit("pdf")).unionByName(rolled.withColumn("side", F.lit("svg"))), 64, 64)
    return found.select("doc_id", "du", "dv", (F.col("response") > 0.99).alias("sure"))


@query("SELECT DISTINCT doc_id, 270 AS rot, 'none' AS flip, 0 AS du, 0 AS dv, true AS sure FROM pdf")
def raster_orientation(spark: SparkSession, d: str) -> DataFrame:
    """A canvas against itself turned by a quarter: three more quarters bring it back."""
    p = _canvas(spark, d, "pdf").withColumn("val", F.lit(1.0))
    t = raster.turn(p, 64, 64, rot=90)
    found = raster.raster_orientation(p.withColumn("side", F.lit("pdf")).unionByName(t.withColumn("side", F.lit("svg"))), 64, 64)
    return found.select("doc_id", "rot", "flip", "du", "dv", (F.col("score") > 0.99).alias("sure"))


@query("SELECT DISTINCT doc_id, true AS near, true AS alike FROM pdf")
def raster_scale(spark: SparkSession, d: str) -> DataFrame:
    """A canvas against itself: the first scale found is within a pixel of 1, as such scales draw the same."""
    p = _canvas(spark, d, "pdf").withColumn("val", F.lit(1.0))
    q = p.withColumn("side", F.lit("svg"))
    found = raster.raster_scale(p.withColumn("side", F.lit("pdf")).unionByName(q), 64, 64, low=0.9, high=1.1)
    return found.select("doc_id", (F.abs(F.col("scale") - 1) <= 0.5 / 32).alias("near"), (F.col("ncc") > 0.999).alias("alike"))


_DIMS = _DIM + """, m AS (SELECT doc_id, orientation, median(ratio) AS m, count(*) AS n FROM pairs GROUP BY ALL),
i AS (SELECT p.doc_id, p.orientation, count(*) AS inliers, median(ratio) AS r FROM pairs p JOIN m USING (doc_id, orientation) WHERE abs(ratio - m) <= 0.1e0 * abs(m) GROUP BY ALL),
dm AS (SELECT doc_id, max(CASE WHEN orientation = 'h' AND inliers >= 3 THEN r END) AS dx, max(CASE WHEN orientation = 'v' AND inliers >= 3 THEN r END) AS dy FROM i GROUP BY doc_id),
z AS (SELECT doc_id, dx, dy, CASE WHEN dx IS NOT NULL AND dy IS NOT NULL THEN (dx + dy) / 2 ELSE coalesce(dx, dy) END AS mean FROM (SELECT DISTINCT doc_id FROM pdf) LEFT JOIN dm USING (doc_id))"""


@query(", " + _DIMS + """, g AS (SELECT *, (1.012e0 + 0.993e0) / 2 * 100 AS ms, abs((1.012e0 + 0.993e0) / 2 * 100 - mean) / abs(mean) * 100 AS gap FROM z)
SELECT doc_id, round(dx, 5) AS dim_x, round(dy, 5) AS dim_y, round(ms, 5) AS model_scale, false AS uneven, round(gap, 5) AS gap, concat_ws('; ', CASE WHEN gap > 5 THEN 'scales differ' END, CASE WHEN mean IS NULL THEN 'no labels' END) AS notes FROM g""")
def metric_scale(spark: SparkSession, d: str) -> DataFrame:
    s = labels.dimension_scale(_label_pairs(spark, d), tol=0.1)
    return rounded(labels.metric_scale(s, _truth(spark, d), pixels_per_unit=100.0), "dim_x", "dim_y", "model_scale", "gap", digits=5)


@query()
def full_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Orientation, fit, lines, matches and report of all documents."""
    return pipeline.run(derived.segments_pdf(spark, d), derived.segments_svg(spark, d), derived.pages(spark, d))["report"]


@query("""SELECT doc_id, count(*) AS segments, round(sum(len), 4) AS total FROM (SELECT doc_id, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM svg) GROUP BY doc_id""")
def arriving_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What the streaming job computes for a micro-batch of drawings."""
    s = derived.segments_svg(spark, d)
    line = F.format_string('<line x1="%s" y1="%s" x2="%s" y2="%s"/>', *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")])
    docs = s.groupBy("doc_id").agg(F.array_join(F.collect_list(line), "").alias("body")).select("doc_id", F.concat(F.lit("<svg>"), "body", F.lit("</svg>")).alias("svg"))
    return rounded(incremental.summaries(docs).select("doc_id", F.col("n").alias("segments"), "total"), "total", digits=4)


@query("""SELECT side, doc_id, count(*) AS n, count(*) FILTER (axis = 'H') AS n_h, count(*) FILTER (axis = 'V') AS n_v, round(min(len), 6) AS min_len, round(quantile_cont(len, 0.5), 6) AS p50_len, round(quantile_cont(len, 0.9), 6) AS p90_len, round(max(len), 6) AS max_len,
  round(quantile_cont(least(ang, 180 - ang), 0.05), 6) AS p05_ang, round(quantile_cont(least(ang, 180 - ang), 0.5), 6) AS p50_ang, round(quantile_cont(least(ang, 180 - ang), 0.95), 6) AS p95_ang FROM feat GROUP BY side, doc_id""")
def seg_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = segments.statistics(feat(spark, d), "side", "doc_id")
    return rounded(s, "min_len", "p50_len", "p90_len", "max_len", "p05_ang", "p50_ang", "p95_ang")


@query("SELECT doc_id, kind, n, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS share FROM (SELECT doc_id, coalesce(axis, 'other') AS kind, count(*) AS n FROM fp GROUP BY ALL)")
def object_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.object_counts(feat(spark, d, "pdf").withColumn("kind", F.coalesce("axis", F.lit("other"))), "doc_id"), "share")


@query(", " + _EDGES + " SELECT vec_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(len, 6) AS len FROM ed WHERE len >= 0.3e0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY len DESC, i) = 1")
def longest_part(spark: SparkSession, d: str) -> DataFrame:
    e = segments.edges(derived.points(spark, d), "vec_id")
    return rounded(segments.longest_part(e, "vec_id", least=0.3), "x1", "y1", "x2", "y2", "len")


@query(""", b AS (SELECT vec_id % 4 AS doc_id, vec_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points GROUP BY vec_id)
SELECT doc_id, vec_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM b WHERE x0 <= -0.2e0 - doc_id / 100e0 AND x1 >= -0.3e0 AND y0 <= -0.25e0 AND y1 >= -0.4e0""")
def boxes_touching(spark: SparkSession, d: str) -> DataFrame:
    p = derived.points(spark, d).withColumn("doc_id", F.col("vec_id") % 4)
    q = spark.range(4).select(F.col("id").alias("doc_id"), F.lit(-0.3).alias("bx0"), F.lit(-0.4).alias("by0"), (F.lit(-0.2) - F.col("id") / 100.0).alias("bx1"), F.lit(-0.25).alias("by1"))
    return rounded(segments.touching_box(p, q, "vec_id"), "x0", "y0", "x1", "y1").select("doc_id", "vec_id", "x0", "y0", "x1", "y1")


@query("""SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_extract(text, '^[0-9]+') <> '0') AS with_value, count(*) FILTER (text LIKE '%m') AS with_unit, list(text ORDER BY txt_id)[1:5]::VARCHAR[] AS examples FROM labels_geo GROUP BY doc_id""")
def text_summary(spark: SparkSession, d: str) -> DataFrame:
    return labels.text_summary(derived.labels(spark, d))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN (p_size + 3) / 2e0 WHEN 2 THEN (p_size + 5e0) / 2 END::DOUBLE AS ppu FROM part")
def pixels_per_unit(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    pairs = lambda **v: F.create_map(*[x for name, c in v.items() for x in (F.lit(name), c if not isinstance(c, str) else F.lit(c))])
    m = F.when(k == 0, pairs(pixels_per_unit=s, scale_x="9")).when(k == 1, pairs(pixels_per_unit="x", scale_x=s, scale_y="3")).when(k == 2, pairs(a=s, b="0", c="3", d="4")).otherwise(pairs(pixels_per_unit="-1"))
    return derived.read(spark, d, "part").select("p_partkey", labels.pixels_per_unit(m).alias("ppu"))


@query(""", r AS (SELECT doc_id, greatest(0e0, least(63e0, round_even(x1 * 63 / 1000e0, 0))) AS u1, greatest(0e0, least(63e0, round_even((800 - y1) * 63 / 800e0, 0))) AS v1, greatest(0e0, least(63e0, round_even(x2 * 63 / 1000e0, 0))) AS u2, greatest(0e0, least(63e0, round_even((800 - y2) * 63 / 800e0, 0))) AS v2 FROM pdf),
s AS (SELECT *, unnest(range(0, n::BIGINT + 1)) AS k FROM (SELECT *, greatest(ceil(greatest(abs(u2 - u1), abs(v2 - v1))), 1) AS n FROM r))
SELECT DISTINCT doc_id, round_even(v1 + (v2 - v1) * (k / n), 0)::BIGINT AS row, round_even(u1 + (u2 - u1) * (k / n), 0)::BIGINT AS col FROM s""")
def raster_upright(spark: SparkSession, d: str) -> DataFrame:
    return raster.draw_upright(derived.segments_pdf(spark, d), "doc_id", size=64, w=W, h=H)


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_id) - 1 AS seg_id, round(x1 * 2 + 1, 6) AS x1, round(y1 * 2 + 3, 6) AS y1, round(x2 * 2 + 1, 6) AS x2, round(y2 * 2 + 3, 6) AS y2 FROM pdf")
def content_scan(spark: SparkSession, d: str) -> DataFrame:
    """Content streams are written from segments, under a matrix, and scanned back."""
    s = derived.segments_pdf(spark, d)
    line = F.format_string("%s %s m %s %s l S", *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")])
    docs = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", line.alias("e")))).alias("a"))
    text = F.concat(F.lit("q 2 0 0 2 1 3 cm "), F.array_join(F.transform("a", lambda x: x["e"]), "\n"), F.lit(" Q 0 0 m 1 1 l n"))
    return rounded(content.segments(docs.select("doc_id", text.alias("content"))), "x1", "y1", "x2", "y2")


@query(", " + _DIMS + " SELECT doc_id, 0 AS rot, 'none' AS flip, 0 AS du, 0 AS dv, round(dx, 5) AS dim_x, round(dy, 5) AS dim_y, true AS near, mean IS NULL AS unlabelled FROM z")
def preprocess(spark: SparkSession, d: str) -> DataFrame:
    """Rasters that are alike, and the page's labels."""
    p = _canvas(spark, d, "pdf").withColumn("val", F.lit(1.0))
    both = p.withColumn("side", F.lit("pdf")).unionByName(p.withColumn("side", F.lit("svg")))
    found = preprocess_.run(both, feat(spark, d, "pdf"), derived.labels(spark, d), rows=64, cols=64)
    return rounded(found.select("doc_id", "rot", "flip", "du", "dv", "dim_x", "dim_y", (F.abs(F.col("scale") - 1) <= 0.5 / 32).alias("near"), F.contains("notes", F.lit("no labels")).alias("unlabelled")), "dim_x", "dim_y", digits=5)


@query("SELECT doc_id, seg_id, round(raw, 6) AS angle, round(len + 0.5e0, 6) AS safe, round(CASE WHEN len > 0 THEN abs((500 - x1) * (y2 - y1) - (400 - y1) * (x2 - x1)) / len END, 5) AS off, round((x2 - x1) * 3 + (y1 - 400) * 2 + 500, 6) AS ax, round(y2 * 3 - y1 * 3 + (x1 - 500) * 2 + 400, 6) AS ay FROM (SELECT *, degrees(atan2(y2 - y1, x2 - x1)) AS raw FROM fp)")
def point_and_line(spark: SparkSession, d: str) -> DataFrame:
    """Signed angles, safe lengths, the page centre's distance from each segment's line, and a map given by three points."""
    s, x1, y1 = geom.seg(), F.col("x1"), F.col("y1")
    m = geom.affine_of_points((F.lit(500.0), F.lit(400.0)), (F.lit(500.0) + (F.col("x2") - x1), F.lit(400.0) + (F.col("y2") - y1)), (F.lit(500.0) + (y1 - 400), F.lit(400.0) + (x1 - 500)))
    ax, ay = m.point(F.lit(3.0), F.lit(2.0))
    f = feat(spark, d, "pdf").select("doc_id", "seg_id", geom.angle(s).alias("angle"), geom.length_eps(s, 0.5).alias("safe"), geom.point_to_line(F.lit(500.0), F.lit(400.0), s).alias("off"), ax.alias("ax"), ay.alias("ay"))
    return rounded(rounded(f, "angle", "safe", "ax", "ay"), "off", digits=5)


@query("""SELECT o_orderkey, CASE WHEN overlap IS NULL THEN 24 WHEN overlap < 0.05e0 THEN 16 ELSE 8 END::DOUBLE AS shift, CASE WHEN overlap IS NULL THEN 0.06e0 WHEN overlap < 0.05e0 THEN 0.04e0 ELSE 0.02e0 END AS scale,
  CASE WHEN overlap IS NULL THEN 60 WHEN overlap < 0.05e0 THEN 60 ELSE 60 END::DOUBLE AS shift_set, CASE WHEN overlap IS NULL THEN 0.12e0 WHEN overlap < 0.05e0 THEN 0.12e0 ELSE 0.12e0 END AS scale_set
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey % 10) / 100e0 END AS overlap FROM orders)""")
def search_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows by overlap: with the usual settings, and with settings beyond the cap of the scale."""
    k = F.col("o_orderkey")
    o = F.when(k % 10 != 0, (k % 10) / 100.0)
    a, b = fit.windows(o), fit.windows(o, scale=0.3, shift=60.0)
    return derived.read(spark, d, "orders").select("o_orderkey", a["shift"].alias("shift"), a["scale"].alias("scale"), b["shift"].alias("shift_set"), b["scale"].alias("scale_set"))


@query(""", h AS (SELECT o_custkey % 40 AS doc_id, o_orderkey AS hyp_id, o_totalprice AS score FROM orders),
a AS (SELECT *, row_number() OVER w AS n, score > max(score) OVER (PARTITION BY doc_id ORDER BY hyp_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY hyp_id)),
b AS (SELECT *, max(CASE WHEN coalesce(up, true) THEN n END) OVER (PARTITION BY doc_id ORDER BY hyp_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a),
c AS (SELECT doc_id, min(n) AS stop FROM b WHERE n - 1 - last >= 9 GROUP BY doc_id)
SELECT doc_id, count(*) AS seen, max(hyp_id) AS hyp_id, max(score) AS score FROM b LEFT JOIN c USING (doc_id) WHERE stop IS NULL OR n < stop GROUP BY doc_id""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """What a search sees that stops after nine hypotheses without a better one."""
    h = derived.read(spark, d, "orders").select((F.col("o_custkey") % 40).alias("doc_id"), F.col("o_orderkey").alias("hyp_id"), F.col("o_totalprice").alias("score"))
    return fit.patient(h, 9).groupBy("doc_id").agg(F.count("*").alias("seen"), F.max("hyp_id").alias("hyp_id"), F.max("score").alias("score"))


@query(", " + _DIM + """, g AS (SELECT *, abs(ratio - 100) <= 50 AS ok FROM pairs), k AS (SELECT doc_id, count(*) FILTER (ok) AS n FROM g GROUP BY doc_id)
SELECT doc_id, seg_id, txt_id, side_of, round(ratio, 5) AS ratio FROM g JOIN k USING (doc_id) WHERE ok OR n = 0""")
def label_gate(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of lines and labels near an expected scale; all of a document that has none."""
    return rounded(labels.gated(_label_pairs(spark, d), 100.0).select("doc_id", "seg_id", "txt_id", "side_of", "ratio"), "ratio", digits=5)


def _written(spark: SparkSession, d: str) -> DataFrame:
    """Drawings (doc_id, svg) with the page's segments, as lines or as paths with a short first part, and with its labels,
    each kind in the order of its ids: a scanned text's id is its place, which decides between labels equally near."""
    f = lambda c: F.col(c).cast("string")
    line = F.format_string('<line x1="%s" y1="%s" x2="%s" y2="%s"/>', *map(f, ("x1", "y1", "x2", "y2")))
    path = F.format_string('<path d="M0 0 L1 0 M%s %s L%s %s"/>', *map(f, ("x1", "y1", "x2", "y2")))
    e = derived.segments_pdf(spark, d).select("doc_id", F.lit(0).alias("kind"), F.col("seg_id").alias("id"), F.when(F.col("seg_id") % 2 == 0, line).otherwise(path).alias("e"))
    at = (F.col("cx") - F.length("text") * 3.0, F.col("cy") + 4.0)
    t = derived.labels(spark, d).select("doc_id", F.lit(1).alias("kind"), F.col("txt_id").alias("id"), F.format_string('<text x="%s" y="%s" font-size="10">%s</text>', at[0].cast("string"), at[1].cast("string"), F.col("text")).alias("e"))
    ordered = F.array_sort(F.collect_list(F.struct("kind", "id", "e")))
    body = e.unionByName(t).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["e"]), "").alias("body"))
    return body.select("doc_id", F.concat(F.lit('<svg viewBox="0 0 1000 800">'), "body", F.lit("</svg>")).alias("svg"))


@query(", " + _DIM + """, m AS (SELECT doc_id, orientation, median(ratio) AS m, count(*) AS n FROM pairs GROUP BY ALL),
i AS (SELECT p.doc_id, p.orientation, count(*) AS inliers, median(ratio) AS r FROM pairs p JOIN m USING (doc_id, orientation) WHERE abs(ratio - m) <= 0.1e0 * abs(m) GROUP BY ALL)
SELECT m.doc_id, m.orientation, m.n, coalesce(inliers, 0) AS inliers, CASE WHEN inliers >= 3 THEN round(r, 4) END AS scale FROM m LEFT JOIN i USING (doc_id, orientation)""")
def drawing_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """The scales that drawings say of themselves, from their text."""
    return rounded(scan.dimensions(_written(spark, d), tol=0.1, diag=(W * W + H * H) ** 0.5), "scale", digits=4)


@query(""", s0 AS (SELECT doc_id, axis, len * 2 AS len, x1 * 2 + 10 AS x1, y1 * 2 - 3 AS y1, x2 * 2 + 10 AS x2, y2 * 2 - 3 AS y2, seg_id FROM fs),
s AS (SELECT doc_id, axis, len, seg_id, CASE axis WHEN 'H' THEN least(x1, x2) ELSE least(y1, y2) END AS lo, CASE axis WHEN 'H' THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS hi, CASE axis WHEN 'H' THEN (y1 + y2) / 2 ELSE (x1 + x2) / 2 END AS off FROM s0 WHERE axis IS NOT NULL),
b AS (SELECT *, round_even(off / 2.37e0, 0) AS bucket FROM s),
r AS (SELECT *, max(hi) OVER (PARTITION BY doc_id, axis, bucket ORDER BY lo, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo - reach > 3.3e0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, axis, bucket ORDER BY lo, seg_id ROWS UNBOUNDED PRECEDING) AS island FROM r),
m AS (SELECT doc_id, axis, bucket, island, min(lo) AS lo, max(hi) AS hi, sum(off * (hi - lo)) / sum(hi - lo) AS pos FROM i GROUP BY ALL)
SELECT doc_id, axis, round(CASE axis WHEN 'H' THEN lo ELSE pos END, 4) AS x1, round(CASE axis WHEN 'H' THEN pos ELSE lo END, 4) AS y1, round(CASE axis WHEN 'H' THEN hi ELSE pos END, 4) AS x2, round(CASE axis WHEN 'H' THEN pos ELSE hi END, 4) AS y2 FROM m
UNION ALL SELECT doc_id, NULL, round(x1, 4), round(y1, 4), round(x2, 4), round(y2, 4) FROM s0 WHERE axis IS NULL""")
def drawing_scan(spark: SparkSession, d: str) -> DataFrame:
    """Drawings read, fitted, snapped and merged in one go."""
    f = lambda c: F.col(c).cast("string")
    mid = [((F.col(a) + F.col(b)) / 2).cast("string") for a, b in (("x1", "x2"), ("y1", "y2"))]
    e = derived.segments_svg(spark, d).select("doc_id", "seg_id", F.format_string('<polyline points="%s,%s %s,%s %s,%s"/>', f("x1"), f("y1"), *mid, f("x2"), f("y2")).alias("e"))
    docs = e.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "e"))), lambda x: x["e"]), "").alias("body"))
    text = F.concat(F.lit('<svg width="3000" height="2000"><g transform="translate(10,-3) scale(2)">'), "body", F.lit("</g></svg>"))
    return halves_up(scan.drawings(docs.select("doc_id", text.alias("svg")), merge={"off_tol": 2.37, "gap_max": 3.3}).select("doc_id", "axis", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", digits=4)


@query(""", p AS (SELECT p_partkey AS doc_id, (p_partkey % 50)::DOUBLE AS x, (p_partkey % 30)::DOUBLE AS y, (5 + p_size)::DOUBLE AS r FROM part),
e AS (SELECT doc_id, 0 AS poly_id, 'path' AS kind, 1 AS edges, x AS x1, y AS y1, x + 30 AS x2, y AS y2, 30e0 AS len FROM p
  UNION ALL SELECT doc_id, 1, 'path', 2, x, y, x + 20, y, 20 FROM p
  UNION ALL SELECT doc_id, 2, 'path', NULL, x, y, x + 2 * r, y, pi() * r FROM p
  UNION ALL SELECT doc_id, 3, 'line', 1, x, y, x + 20, y + 10, sqrt(500e0) FROM p
  UNION ALL SELECT doc_id, 4, 'line', 1, 7 - y, x, 7 - y, x + 5, 5 FROM p
  UNION ALL SELECT doc_id, 5, 'rect', 4, x, y, x, y, 2 * (r + 3) FROM p
  UNION ALL SELECT doc_id, 6, 'polygon', 3, x, y, x, y, 12 FROM p
  UNION ALL SELECT doc_id, 7, 'line', 1, x + 1, y + 2, x + 1 + r, y + 2, r FROM p)
SELECT doc_id, poly_id::INT AS poly_id, kind, edges::INT AS edges, round(x1 * 2 + 50, 5) AS x1, round(y1 * 2, 5) AS y1, round(x2 * 2 + 50, 5) AS x2, round(y2 * 2, 5) AS y2, CASE WHEN edges IS NULL THEN 1e0 ELSE round(len * 2, 5) END AS len FROM e""")
def svg_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Curves, arcs, references, turns and view boxes: a drawing for each part, of which each polyline's ends and length are
    known; an arc's length is compared with the circle's to 2 %."""
    p = derived.read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 50).cast("string").alias("x"), (F.col("p_partkey") % 30).cast("string").alias("y"), (F.col("p_size") + 5).alias("r"))
    x, y, r = F.col("x"), F.col("y"), F.col("r").cast("string")
    text = F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" viewBox="0 0 200 100" width="500" height="200"><defs><symbol id="s" viewBox="0 0 10 10"><line x1="0" y1="0" x2="10" y2="5"/></symbol><line id="l" x1="1" y1="2" x2="'),
        (F.col("r") + 1).cast("string"), F.lit('" y2="2"/></defs><path d="M'), x, F.lit(" "), y, F.lit('c10 0 20 0 30 0"/><path d="M'), x, F.lit(","), y, F.lit('q5 0 10 0t10 0"/><path d="M'), x, F.lit(" "), y, F.lit("a"), r, F.lit(" "), r, F.lit(" 0 0 1 "), (F.col("r") * 2).cast("string"),
        F.lit(' 0"/><use href="#s" x="'), x, F.lit('" y="'), y, F.lit('" width="20" height="20"/><g transform="translate(7,0) rotate(90)"><line x1="'), x, F.lit('" y1="'), y, F.lit('" x2="'), (x.cast("int") + 5).cast("string"), F.lit('" y2="'), y, F.lit('"/></g><rect x="'), x, F.lit('" y="'), y, F.lit('" width="'), r, F.lit('" height="3"/><polygon points="'),
        x, F.lit(","), y, F.lit(" "), (x.cast("int") + 4).cast("string"), F.lit(","), y, F.lit(" "), x, F.lit(","), (y.cast("int") + 3).cast("string"), F.lit('"/><use xlink:href="#l" x="'), x, F.lit('" y="'), y, F.lit('"/></svg>'),
    )
    pts = svg.polylines(p.select("doc_id", text.alias("svg")))
    ends = pts.groupBy("doc_id", "poly_id").agg(F.first("kind").alias("kind"), *[f(c, "i").alias(f"{c}{k}") for k, f in ((1, F.min_by), (2, F.max_by)) for c in ("x", "y")])
    e = segments.edges(pts, "doc_id", "poly_id").groupBy("doc_id", "poly_id").agg(F.count("*").cast("int").alias("edges"), F.sum(geom.length(geom.seg())).alias("len"))
    arc = F.col("poly_id") == 2
    j = ends.join(e, ["doc_id", "poly_id"]).join(p.select("doc_id", "r"), "doc_id")
    whole = F.when(F.abs(F.col("len") / (F.pi() * F.col("r") * 2) - 1) < 0.02, 1.0).otherwise(F.col("len"))
    return rounded(j.select("doc_id", "poly_id", "kind", F.when(~arc, F.col("edges")).alias("edges"), "x1", "y1", "x2", "y2", F.when(arc, whole).otherwise(F.col("len")).alias("len")), "x1", "y1", "x2", "y2", "len", digits=5)


@query("""SELECT doc_id, row - 5 AS row, col + floor((30 - (SELECT max(col) + 1 FROM pixels)) / 2e0)::BIGINT AS col, val FROM pixels WHERE row BETWEEN 8 AND 31 AND col BETWEEN (SELECT floor((max(col) + 1) * 0.2e0) FROM pixels) AND (SELECT max(col) - floor((max(col) + 1) * 0.2e0) FROM pixels)
AND row - 5 BETWEEN 0 AND 29 AND col + floor((30 - (SELECT max(col) + 1 FROM pixels)) / 2e0) BETWEEN 0 AND 29""")
def raster_crop_fit(spark: SparkSession, d: str) -> DataFrame:
    """Canvases without their margins, about the centre of another canvas."""
    p = derived.pixels(spark, d)
    wide = (p.agg(F.max("col")).first()[0] or 0) + 1
    inner = raster.crop_margin(p, 40, wide, 0.2)
    return raster.center_fit(inner, 40 - 2 * int(40 * 0.2), wide - 2 * int(wide * 0.2), 30, 30).select("doc_id", "row", "col", "val")


@query(""", m AS (SELECT doc_id, row, col FROM pixels WHERE val > 90 AND col < (SELECT max(col) + 1 FROM pixels)), g AS (SELECT doc_id, row, col FROM (SELECT DISTINCT doc_id FROM m), (SELECT unnest(range(40)) AS row), (SELECT unnest(range((SELECT max(col) + 1 FROM pixels))) AS col))
SELECT g.doc_id, g.row, g.col, round(sqrt(min((g.row - m.row) * (g.row - m.row) + (g.col - m.col) * (g.col - m.col))), 6) AS d FROM g JOIN m USING (doc_id) GROUP BY g.doc_id, g.row, g.col""")
def raster_distance(spark: SparkSession, d: str) -> DataFrame:
    """Each pixel's distance from the nearest bright one."""
    p = derived.pixels(spark, d)
    wide = (p.agg(F.max("col")).first()[0] or 0) + 1
    return rounded(raster.distance_maps(p.where("val > 90"), 40, wide), "d")


@query(""", n AS (SELECT max(col) + 1 AS wide FROM pixels), g AS (SELECT DISTINCT doc_id FROM pixels), t AS (SELECT doc_id, r, c, greatest(0e0, least(39e0, (r + 0.5e0) * 2 - 0.5e0)) AS fr, greatest(0e0, least(wide - 1e0, (c + 0.5e0) * wide / 25e0 - 0.5e0)) AS fc, wide FROM g, n, (SELECT unnest(range(20)) AS r), (SELECT unnest(range(25)) AS c)),
q AS (SELECT *, floor(fr)::BIGINT AS r0, floor(fc)::BIGINT AS c0 FROM t), k AS (SELECT *, least(r0 + 1, 39) AS r1, least(c0 + 1, wide - 1) AS c1 FROM q),
v AS (SELECT k.*, coalesce(a.val, 0) AS a, coalesce(b.val, 0) AS b, coalesce(c_.val, 0) AS c_, coalesce(e.val, 0) AS e FROM k LEFT JOIN pixels a ON a.doc_id = k.doc_id AND a.row = r0 AND a.col = c0 LEFT JOIN pixels b ON b.doc_id = k.doc_id AND b.row = r0 AND b.col = c1 LEFT JOIN pixels c_ ON c_.doc_id = k.doc_id AND c_.row = r1 AND c_.col = c0 LEFT JOIN pixels e ON e.doc_id = k.doc_id AND e.row = r1 AND e.col = c1)
SELECT doc_id, r AS row, c AS col, round(a * (1 - (fr - r0)) * (1 - (fc - c0)) + b * (1 - (fr - r0)) * (fc - c0) + c_ * (fr - r0) * (1 - (fc - c0)) + e * (fr - r0) * (fc - c0), 5) AS val FROM v""")
def raster_resize(spark: SparkSession, d: str) -> DataFrame:
    """Canvases resized to 20 by 25 pixels."""
    p = derived.pixels(spark, d)
    wide = (p.agg(F.max("col")).first()[0] or 0) + 1
    return rounded(raster.resizes(p, 40, wide, 20, 25), "val", digits=5)


@query(", " + _BOX + """, h AS (SELECT side, doc_id, least(floor(greatest(0e0, least(1e0, (cy - min_y) / greatest(max_y - min_y, 1e-6))) * 16), 15)::INT AS iy, least(floor(greatest(0e0, least(1e0, (cx - min_x) / greatest(max_x - min_x, 1e-6))) * 16), 15)::INT AS ix, count(*) AS n FROM feat JOIN box USING (side, doc_id) GROUP BY ALL),
v AS (SELECT side, doc_id, iy, ix, n / max(n) OVER (PARTITION BY side, doc_id) AS v FROM h),
c AS (SELECT a.doc_id, (a.iy - b.iy + 16) % 16 AS ky, (a.ix - b.ix + 16) % 16 AS kx, sum(a.v * b.v) AS s FROM v a JOIN v b USING (doc_id) WHERE a.side = 'pdf' AND b.side = 'svg' GROUP BY ALL)
SELECT doc_id, CASE WHEN kx <= 8 THEN kx ELSE kx - 16 END::INT AS kx, CASE WHEN ky <= 8 THEN ky ELSE ky - 16 END::INT AS ky, round(s, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, ky, kx) = 1""")
def heatmap_shift(spark: SparkSession, d: str) -> DataFrame:
    """The coarse search's fallback: the shift of both sides' heatmaps."""
    return rounded(hypotheses.heatmap_shift(feat(spark, d, "pdf"), feat(spark, d, "svg"), size=16), "score")


@query()
def calibrated_models(spark: SparkSession, d: str) -> DataFrame:
    """Models with the coarse search on, checked by distance maps."""
    cfg = {"coarse": {"enabled": True}, "verify": {"mode": "distmap"}}
    return pipeline.models(derived.segments_pdf(spark, d), derived.segments_svg(spark, d), derived.pages(spark, d), cfg)


#: The second page of the written files is turned: a square and a text, each where it is shown.
_SECOND = "(VALUES (0, 20e0, 80e0, 20e0, 60e0), (1, 20e0, 60e0, 40e0, 60e0), (2, 40e0, 60e0, 40e0, 80e0), (3, 40e0, 80e0, 20e0, 80e0)) AS v(seg_id, x1, y1, x2, y2)"


def _page_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each document: a page of its segments, and a turned one with a square and the document's number."""
    line = F.format_string("%.9f %.9f m %.9f %.9f l S", "x1", "y1", "x2", "y2")
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", line.alias("e")))), lambda x: x["e"]), "\n")
    s = derived.segments_pdf(spark, d).groupBy("doc_id").agg(one.alias("one"))
    two = F.concat(F.lit("30 40 20 20 re S BT /F1 12 Tf 30 40 Td (No. \\("), F.col("doc_id").cast("string"), F.lit("\\)) Tj ET"))
    file = [F.lit("%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Type/Pages/Kids[3 0 R 4 0 R]/Count 2/MediaBox[0 0 1000 800]>> endobj 3 0 obj <</Type/Page/Parent 2 0 R/Contents 5 0 R>> endobj 4 0 obj <</Type/Page/Parent 2 0 R/Rotate 90/MediaBox[10 20 110 320]/Contents 6 0 R>> endobj\n")]
    for n, c in ((5, F.col("one")), (6, two)):
        file += [F.format_string(f"{n} 0 obj <</Length %d>>\nstream\n", F.length(c)), c, F.lit("\nendstream endobj\n")]
    return s.select("doc_id", F.concat(*file).cast("binary").alias("pdf"))


@query("SELECT doc_id, page_index, 2 AS n_pages, w, h, NULL::VARCHAR AS error FROM (SELECT DISTINCT doc_id FROM pdf), (VALUES (0, 1000e0, 800e0), (1, 300e0, 100e0)) AS v(page_index, w, h)")
def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    return pdf.pages(_page_files(spark, d))


@query(f"""SELECT doc_id, 0 AS page_index, row_number() OVER (PARTITION BY doc_id ORDER BY seg_id) - 1 AS seg_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM pdf
UNION ALL SELECT doc_id, 1, seg_id, x1, y1, x2, y2 FROM (SELECT DISTINCT doc_id FROM pdf), {_SECOND}""")
def pdf_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pdf.segments(_page_files(spark, d)), "x1", "y1", "x2", "y2")


@query("SELECT DISTINCT doc_id, 1 AS page_index, 0 AS txt_id, 'No. (' || doc_id || ')' AS text, 20e0 AS x, 80e0 AS y, 12e0 AS font FROM pdf")
def pdf_texts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pdf.texts(_page_files(spark, d)), "x", "y", "font")


@query(f"SELECT doc_id, seg_id, x1, y1, x2, y2 FROM (SELECT DISTINCT doc_id FROM pdf), {_SECOND}")
def pdf_extracted(spark: SparkSession, d: str) -> DataFrame:
    """The second page as a file of its own, read again."""
    return rounded(pdf.segments(pdf.extracted(_page_files(spark, d), 1)).drop("page_index"), "x1", "y1", "x2", "y2")


@query("SELECT doc_id, round(x1, 5) AS x1, round(800 - y1, 5) AS y1, round(x2, 5) AS x2, round(800 - y2, 5) AS y2 FROM pdf")
def pdf_to_svg(spark: SparkSession, d: str) -> DataFrame:
    """First pages made into drawings, whose segments are read."""
    return rounded(svg.segments(pdf.drawings(_page_files(spark, d), page=0)).select("doc_id", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", digits=5)


@query("SELECT doc_id, pick, round(x1, 5) AS x1, round(y1, 5) AS y1, round(x2, 5) AS x2, round(y2, 5) AS y2 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, seg_id) AS pick FROM fp) WHERE pick <= 3")
def pdf_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The three longest segments of each document drawn over its second page, which is turned, and read from there."""
    top = segments.top_absolute(feat(spark, d, "pdf"), 3, "doc_id")
    chosen = top.select("doc_id", F.col("rank").alias("pick"), "x1", "y1", "x2", "y2", F.lit(False).alias("matched"))
    said = chosen.select("doc_id").distinct().withColumn("text", F.lit("one (1)\ntwo"))
    got = pdf.segments(pdf.overlaid(_page_files(spark, d), chosen, said, page=1)).where(F.col("seg_id").between(4, 6))
    return rounded(got.select("doc_id", (F.col("seg_id") - 3).alias("pick"), "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", digits=5)


_GRAY = """, r AS (SELECT doc_id, u1, v1, u2 - u1 AS du, v2 - v1 AS dv FROM (SELECT doc_id, x1 * 0.5e0 AS u1, (800 - y1) * 0.5e0 AS v1, x2 * 0.5e0 AS u2, (800 - y2) * 0.5e0 AS v2 FROM pdf)),
w AS (SELECT *, greatest(0, CASE WHEN du = 0 THEN 0 ELSE least(-u1 / du, (500 - u1) / du) END, CASE WHEN dv = 0 THEN 0 ELSE least(-v1 / dv, (400 - v1) / dv) END) AS a,
  least(1, CASE WHEN du = 0 THEN 1 ELSE greatest(-u1 / du, (500 - u1) / du) END, CASE WHEN dv = 0 THEN 1 ELSE greatest(-v1 / dv, (400 - v1) / dv) END) AS b FROM r),
c AS (SELECT doc_id, least(greatest(u1 + du * a, 0), 500) AS u1, least(greatest(v1 + dv * a, 0), 400) AS v1, least(greatest(u1 + du * b, 0), 500) AS u2, least(greatest(v1 + dv * b, 0), 400) AS v2 FROM w
  WHERE a <= b AND (du <> 0 OR u1 BETWEEN 0 AND 500) AND (dv <> 0 OR v1 BETWEEN 0 AND 400)),
s AS (SELECT *, unnest(range(0, n::BIGINT + 1)) / n AS t FROM (SELECT *, greatest(ceil(greatest(abs(u2 - u1), abs(v2 - v1))), 1) AS n FROM c)),
gray AS (SELECT DISTINCT doc_id, least(floor(v1 + (v2 - v1) * t), 399)::BIGINT AS row, least(floor(u1 + (u2 - u1) * t), 499)::BIGINT AS col, 255 AS val FROM s)"""


def _gray(spark: SparkSession, d: str) -> DataFrame:
    return raster.render(derived.segments_pdf(spark, d), derived.pages(spark, d).where("side = 'pdf'"), zoom=0.5)


@query(_GRAY + " SELECT * FROM gray")
def page_render(spark: SparkSession, d: str) -> DataFrame:
    return _gray(spark, d)


@query(_GRAY + " SELECT doc_id, row - 60 AS row, col AS col, val FROM gray WHERE row BETWEEN 60 AND 190 AND col BETWEEN 0 AND 120")
def page_preview(spark: SparkSession, d: str) -> DataFrame:
    box = derived.pages(spark, d).select("doc_id").distinct().select("doc_id", *[F.lit(n).alias(c) for c, n in (("row0", 110), ("col0", 30), ("row1", 140), ("col1", 70))])
    return raster.preview(_gray(spark, d), box)
