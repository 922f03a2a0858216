"""Operators on small literal tables: known transforms are recovered, and the rules of each step hold."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill import config, durable
from segmill.functions import geom
from segmill.operators import assign, fit, hypotheses, labels, match, profiles, raster, segments, spatial
from segmill.plans import pipeline


def table(spark, data, side="pdf", doc=1):
    return spark.createDataFrame([(doc, side, i, *map(float, s)) for i, s in enumerate(data)], "doc_id long, side string, seg_id long, x1 double, y1 double, x2 double, y2 double")


def grid(rng, nh, nv, w, h):
    out = []
    for _ in range(nh):
        x, y, n = rng.uniform(0, w * 0.6), rng.uniform(0, h), rng.uniform(w * 0.1, w * 0.4)
        out.append((x, y, x + n, y))
    for _ in range(nv):
        x, y, n = rng.uniform(0, w), rng.uniform(0, h * 0.6), rng.uniform(h * 0.1, h * 0.4)
        out.append((x, y, x, y + n))
    return out


def test_axis_classes(spark):
    f = segments.features(table(spark, [(0, 0, 10, 0.2), (0, 0, 0.2, -10), (0, 0, 5, 5), (3, 3, 3, 3)]))
    got = {r.seg_id: (r.axis, round(r.ang, 3)) for r in f.collect()}
    assert got[0] == ("H", 1.146) and got[1][0] == "V" and got[2] == (None, 45.0) and got[3] == ("H", 0.0)


def test_line_fit_numbers(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 5.0, 0.0), (1, 2, 10.0, 0.1)], "k int, i int, x double, y double")
    r = segments.line_fit(p, "k").first()
    assert r.max_off == pytest.approx(0.03333, abs=1e-4) and r.rms_off == pytest.approx(0.02357, abs=1e-4)


@pytest.mark.parametrize("data,want", [([(0, 0, 4, 0), (4.5, 0, 8, 0), (8.2, 0.1, 12, 0.1)], 1), ([(0, 0, 4, 0), (4.5, 3, 8, 3)], 2), ([(0, 0, 4, 0), (5, 0, 8, 4)], 2), ([(0, 0, 10, 0), (2, 0, 3, 0), (10.5, 0, 12, 0)], 1)])
def test_merge(spark, data, want):
    m = segments.merge_collinear(segments.features(table(spark, data)), off_tol=1.0, gap_max=1.0)
    assert m.count() == want and m.agg(F.sum("n")).first()[0] == len(data)


def test_prefilter_keeps_all_when_none_is_long(spark):
    f = segments.features(table(spark, [(0, 0, 1, 0), (0, 0, 2, 0)]))
    pages = spark.createDataFrame([(1, "pdf", 100.0, 100.0)], "doc_id long, side string, w double, h double")
    assert segments.prefilter(f, pages, 0.5).count() == 2
    assert segments.prefilter(f, pages, 0.012).count() == 1


def test_grid_join_is_brute_force(spark):
    rng = random.Random(4)
    a = [(1, i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(120)]
    b = [(1, i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(120)]
    got = spatial.grid_join(spark.createDataFrame(a, "doc_id long, p long, lx double, ly double"), spark.createDataFrame(b, "doc_id long, s long, rx double, ry double"), 7.0)
    want = {(p[1], s[1]) for p in a for s in b if math.hypot(p[2] - s[2], p[3] - s[3]) <= 7}
    assert sorted((r.p, r.s) for r in got.collect()) == sorted(want)


def test_hungarian_is_best():
    r = np.random.default_rng(0)
    for k in range(300):
        n, m = int(r.integers(1, 6)), int(r.integers(1, 7))
        c = r.integers(0, 9, (n, m)).astype(float) if k % 2 else r.random((n, m))
        got = assign.hungarian(c)
        few, many = (c, m) if n <= m else (c.T, n)
        want = min(sum(few[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(many), min(n, m)))
        assert len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m)
        assert sum(c[i, j] for i, j in got) == pytest.approx(want)


def test_signature_cost():
    a = [(0.1, 0.0, 1.0), (0.5, 90.0, 2.0)]
    assert assign.signature_cost([], a) == 5.0
    assert assign.signature_cost(a, a) == 0.0
    assert assign.signature_cost(a, a[:1]) == 1.5
    assert assign.signature_cost(a[:1], a) == 0.5


def test_diverse_choice():
    rows = [(i, "H", 10.0 * i, 0.0) for i in range(5)] + [(9, "V", 0.0, 50.0)]
    chosen, notes = assign.pick_diverse(rows, 5, 15.0)
    assert [r[0] for r in chosen[:3]] == [0, 2, 9] and len(chosen) == 5 and "1 of 2 V" in notes and "distance relaxed" in notes
    assert assign.pick_diverse(rows[:1], 3, 1.0)[1][-1] == "1 of 3 lines"


def test_transform_conventions_agree_at_rest(spark):
    p = spark.createDataFrame([(3.0, 5.0)], "x double, y double")
    args = [F.lit(0), F.lit(1.0), F.lit(-1.0), F.lit(1.5), F.lit(0.5), F.lit(2.0), F.lit(1.0)]
    a, b, c = geom.fit_affine(*args, F.lit(20.0), F.lit(10.0)), geom.match_affine(*args), geom.matrix_affine(*args)
    r = p.select(*[v.alias(f"c{i}") for i, v in enumerate(x for t in (a, b, c) for x in t.point(F.col("x"), F.col("y")))]).first()
    assert tuple(r) == (6.5, -1.5) * 3


@pytest.mark.parametrize("rot,fx,fy", list(itertools.product((0, 180), (1, -1), (1, -1))))
def test_orientation_is_found(spark, rot, fx, fy):
    rng = random.Random(rot + 7 * fx + 11 * fy)
    w, h = 220.0, 170.0
    data = [(rng.uniform(10, 100), rng.uniform(10, 80), rng.uniform(20, 150), rng.uniform(20, 90)) for _ in range(14)]
    sx, sy = fx * (-1 if rot == 180 else 1), fy * (-1 if rot == 180 else 1)
    move = lambda x, y: ((w - x if sx < 0 else x) + 6.5, (h - y if sy < 0 else y) - 4)
    svg = [(*move(s[0], s[1]), *move(s[2], s[3])) for s in data]
    o = hypotheses.orientation(table(spark, data), table(spark, svg, "svg"), hypotheses.flips(spark), w=w, h=h, svg_w=w, svg_h=h, bins=44)
    b = hypotheses.best(o, "key", "response").first()
    turned = -1 if b.rot == 180 else 1
    assert (b.fx * turned, b.fy * turned) == (sx, sy)
    assert abs(b.dx - 6.5) <= 6 and abs(b.dy + 4) <= 6


def test_fit_recovers_scale_and_shift(spark):
    rng = random.Random(2)
    data = grid(rng, 12, 14, 980, 720)
    sx, sy, tx, ty = 1.03, 0.985, 6.0, -7.0
    svg = [(sx * a + tx, sy * b + ty, sx * c + tx, sy * d + ty) for a, b, c, d in data]
    seeds = spark.createDataFrame([(1, 1.03, 0.98, 0.0, 0.0)], "doc_id long, sx0 double, sy0 double, tx0 double, ty0 double")
    m = fit.fit(segments.features(table(spark, data)), segments.features(table(spark, svg, "svg")), seeds, iters=80).first()
    assert m.sx == pytest.approx(sx, rel=0.01) and m.sy == pytest.approx(sy, rel=0.01)
    assert abs(m.tx - tx) <= 4 and abs(m.ty - ty) <= 4 and m.rmse < 12 and m.quality_notes == []


def test_whole_pipeline_on_a_mirrored_drawing(spark):
    rng = random.Random(5)
    data = grid(rng, 14, 14, 600, 400)
    svg = [(1.1 * (600 - a) + 5, 0.9 * b + 3, 1.1 * (600 - c) + 5, 0.9 * d + 3) for a, b, c, d in data]
    pages = spark.createDataFrame([(1, "pdf", 600.0, 400.0), (1, "svg", 660.0, 360.0)], "doc_id long, side string, w double, h double")
    out = pipeline.run(table(spark, data), table(spark, svg, "svg"), pages, {"fit": {"iters": 60}})
    m = out["models"].first()
    assert (m.fx, m.fy) == (-1, 1) and m.sx == pytest.approx(1.1, rel=0.01) and m.tx == pytest.approx(665, abs=6)
    assert out["matches"].where("s_id = seg_id and pass01 = 1").count() == 5
    assert out["report"].count() == 5


@pytest.mark.parametrize("rot,flip", [(0, "none"), (0, "x"), (90, "none"), (180, "y"), (270, "x")])
def test_coarse_search_lays_the_drawing_on_the_page(spark, rot, flip):
    """A turned, flipped and scaled copy comes back onto the page's segments."""
    rng = random.Random(rot + len(flip))
    # The search turns within the drawing's own box, so a quarter turn needs a square one.
    w, h = (200.0, 200.0) if rot % 180 else (240.0, 180.0)
    ky = 1.3 if rot % 180 else 0.8
    data = [(0, 0, w, 0), (w, 0, w, h)]
    for _ in range(70):
        x, y, n = rng.uniform(5, w * 0.6), rng.uniform(5, h - 10), rng.uniform(20, 60)
        data.append((x, y, x + n, y))
    for _ in range(45):
        x, y, n = rng.uniform(5, w - 10), rng.uniform(5, h * 0.5), rng.uniform(20, 80)
        data.append((x, y, x, y + n))
    table_ = table(spark, data)

    def away(x, y):
        """What the search's turn and flip lead back to (x, y)."""
        x, y = w - x if flip == "x" else x, h - y if flip == "y" else y
        u, v = {0: (x, y), 90: (h - y, x), 180: (w - x, h - y), 270: (y, w - x)}[rot]
        return 1.3 * u + 7, ky * v - 2

    svg = [(*away(x1, y1), *away(x2, y2)) for x1, y1, x2, y2 in data]
    page, drawing = segments.features(table_), segments.features(table(spark, svg, "svg"))
    found = hypotheses.coarse_best(page, drawing, shares=(0.4, 1.0), tols=(6.0,), len_tol=0.3)
    r = found.first()
    assert r.score > 0.9  # a half turn and one flip are the other flip, so names can differ
    moved = segments.features(hypotheses.coarse_moved(drawing, found))
    near = spatial.nearest(segments.sample_steps(moved, 20.0), page, 12.0).agg(F.avg("d")).first()[0]
    assert near < 4


def test_heatmaps_stand_in_where_segments_are_too_few(spark):
    page = segments.features(table(spark, [(0, 0, 100, 0), (0, 0, 0, 80), (100, 80, 90, 80)]))
    found = hypotheses.coarse_best(page, page.withColumn("side", F.lit("svg")), least=50).first()
    assert (found.level, found.rot, found.flip, found.dx, found.dy) == (-1, 0, "none", 0.0, 0.0) and found.score > 0


def test_a_wide_bound_on_distances_is_looked_up_and_gives_what_the_join_gives(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for shape, hard in (((9, 7), 3.0), ((12, 30), 5.5), ((6, 6), 50.0), ((5, 8), 0.5)):
        for share in (0.0, 0.03, 0.4):
            m = rng.random(shape) < share
            assert np.array_equal(raster.bounded_map(m, hard), np.minimum(raster.distance_map(m), hard))
    # The third document has no drawing, the fourth no points, and a null id meets none.
    lines = [(d, *rng.uniform(0, 60, 4).tolist()) for d in (1, 2, 4, None) for _ in range(3)]
    svg = spark.createDataFrame(lines, "doc_id long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(d, *rng.uniform(-5, 70, 2).tolist()) for d in (1, 2, 3, None) for _ in range(200)], "doc_id long, px double, py double")
    got = raster.distance_quality(svg, points, size=64, w=63.0, h=63.0, hard=7.5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(raster, "NARROW", 100.0)
    want = raster.distance_quality(svg, points, size=64, w=63.0, h=63.0, hard=7.5)
    table_ = lambda df: sorted(((r.doc_id or 0, r.n, *[round(r[c], 9) for c in ("rmse", "p95", "median", "score")]) for r in df.collect()))
    assert table_(got) == table_(want) and len(table_(got)) == 4
    # Pixels times drawn pixels in reach are no rows of a join.
    assert "_gx#" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_models_alone_are_those_of_the_whole_run_without_its_matches(spark, monkeypatch):
    data = grid(random.Random(3), 12, 12, 600, 500)
    pages = spark.createDataFrame([(1, "pdf", 600.0, 500.0), (1, "svg", 600.0, 500.0)], "doc_id long, side string, w double, h double")
    sides, cfg = (table(spark, data), table(spark, [(a + 3, b - 2, c + 3, d - 2) for a, b, c, d in data], "svg"), pages), {"fit": {"iters": 20}}
    want = pipeline.run(*sides, cfg)["models"].collect()
    steps = []
    monkeypatch.setattr(pipeline, "materialize", lambda df, label, *rest: steps.append(label) or durable.materialize(df, label, *rest))
    assert pipeline.models(*sides, cfg).collect() == want and steps[-1] == "models"


def test_hypotheses_that_mirror_alike_share_an_image(spark, monkeypatch):
    data = grid(random.Random(5), 10, 8, 600, 500)
    sides = table(spark, data), table(spark, [(600 - a, b, 600 - c, d) for a, b, c, d in data], "svg")
    drawn, plain = [], raster.draw
    monkeypatch.setattr(raster, "draw", lambda segs, *keys, **how: drawn.append((segs, keys)) or plain(segs, *keys, **how))
    size = {"w": 600.0, "h": 500.0, "svg_w": 600.0, "svg_h": 500.0}
    got = {r.hyp_id: r for r in hypotheses.orientation(*sides, hypotheses.flips(spark), **size).collect()}
    moved = next(segs for segs, keys in drawn if "hyp_id" in keys)
    assert moved.count() == 4 * len(data) and len(got) == 8
    for k, r in got.items():  # each alone is what all together are
        alone = hypotheses.orientation(*sides, hypotheses.flips(spark).where(F.col("hyp_id") == k), **size).collect()
        assert alone == [r] and [r.rot, r.fx, r.fy] == list(hypotheses.flips(spark).collect()[k])[1:]
    best = max(got.values(), key=lambda r: (round(r.key, 9), -r.hyp_id))
    assert (best.rot, best.fx, best.fy) == (0, -1, 1)


def test_drawn_pixels_are_those_of_stepping_along_each_segment(spark):
    rng = np.random.default_rng(2)
    data = [tuple(v) for v in rng.uniform(-20, 180, (40, 4)).tolist()]
    for size in (5, 64, 65, 200):
        want = set()
        for a, b, c, d in data:
            u1, v1, u2, v2 = (x / 160 * (size - 1) for x in (a, b, c, d))
            n = max(1, math.ceil(max(abs(u2 - u1), abs(v2 - v1))))
            want |= {(round(v1 + (v2 - v1) * (k / n)), round(u1 + (u2 - u1) * (k / n))) for k in range(n + 1)}
        got = raster.draw(table(spark, data), "doc_id", size=size, w=160.0, h=160.0)
        assert sorted((r.row, r.col) for r in got.collect()) == sorted(x for x in want if 0 <= min(x) and max(x) < size)
        assert dict(got.dtypes) == {"doc_id": "bigint", "row": "bigint", "col": "bigint"}


def test_pipeline_with_the_coarse_search_and_distance_maps(spark):
    rng = random.Random(5)
    data = grid(rng, 14, 14, 600, 400)
    svg = [(1.1 * (600 - a) + 5, 0.9 * b + 3, 1.1 * (600 - c) + 5, 0.9 * d + 3) for a, b, c, d in data]
    pages = spark.createDataFrame([(1, "pdf", 600.0, 400.0), (1, "svg", 660.0, 360.0)], "doc_id long, side string, w double, h double")
    out = pipeline.run(table(spark, data), table(spark, svg, "svg"), pages, {"fit": {"iters": 60}, "coarse": {"enabled": True}, "verify": {"mode": "distmap"}})
    assert out["coarse"].first().flip == "x"
    m = out["models"].first()
    assert (m.fx, m.fy) == (1, 1) and m.sx == pytest.approx(1, rel=0.02) and m.sy == pytest.approx(1, rel=0.02) and 0 < m.score <= 1
    assert out["report"].columns == ["doc_id", *match.REPORT] and len(match.REPORT) == 28


def test_a_fit_below_the_gate_gets_a_second_one(spark):
    rng = random.Random(6)
    data = grid(rng, 8, 8, 600, 400)
    svg = [(a + 3, b, c + 3, d) for a, b, c, d in grid(random.Random(77), 8, 8, 600, 400)]
    pages = spark.createDataFrame([(1, s, 600.0, 400.0) for s in ("pdf", "svg")], "doc_id long, side string, w double, h double")
    for least, said in ((0.999, "below threshold after fallback"), (0.0, None)):
        gate = {"refine": {"quality_gate": {"score_min": least, "rmse_px": 1e9}}, "fit": {"iters": 20}}
        notes = pipeline.calibrate(table(spark, data), table(spark, svg, "svg"), pages, gate).first().quality_notes
        assert (said in notes[0]) if said else notes == []


def test_patience_is_that_of_a_search_in_order(spark):
    rng = random.Random(4)
    rows = [(doc, i, rng.random()) for doc in range(6) for i in range(80)]
    for patience in (0, 1, 5, 20):
        got = fit.patient(spark.createDataFrame(rows, "doc_id long, hyp_id int, score double"), patience).collect()
        want = []
        for doc in range(6):
            top, idle = -1.0, 0
            for d, i, s in rows:
                if d != doc:
                    continue
                if patience and idle >= patience:
                    break
                want.append((d, i))
                top, idle = (s, 0) if s > top else (top, idle + 1)
        assert sorted((r.doc_id, r.hyp_id) for r in got) == want


def test_cells_along_a_segment_hold_all_that_is_near(spark):
    """Every point within the bound of a segment lies in one of its cells, and a diagonal has few of them."""
    rng = random.Random(9)
    segs = [tuple(rng.uniform(-50, 50) for _ in range(4)) for _ in range(40)] + [(0, 0, 0, 30), (0, 0, 30, 0), (5, 5, 5, 5), (0, 0, 48, 48), (12, 12, 24, 24)]
    got = {}
    for r in spatial.cover(table(spark, segs).withColumn("k", F.col("seg_id")).withColumn("doc_id", F.col("seg_id")), 6.0).collect():
        got.setdefault(r.doc_id, set()).add((r._gx, r._gy))
    for k, (x1, y1, x2, y2) in enumerate(segs):
        for _ in range(300):
            t, a, b = rng.random(), rng.uniform(-6, 6), rng.uniform(-6, 6)
            x, y = x1 + (x2 - x1) * t + a, y1 + (y2 - y1) * t + b
            assert (math.floor(x / 6), math.floor(y / 6)) in got[k]
    assert len(got[43]) < 80  # its box has 121


def test_choice_of_lines():
    line = lambda i, a, x, y: (i, a, float(x), float(y))
    h, v = [line(i, "H", 30 * i, 0) for i in range(6)], [line(10 + i, "V", 0, 40 + 30 * i) for i in range(6)]
    chosen, notes = assign.pick_diverse(h[:3] + v[:3], 5, 10.0)
    assert len(chosen) == 5 and sum(c[1] == "H" for c in chosen) >= 2 and sum(c[1] == "V" for c in chosen) >= 2 and not notes
    chosen, notes = assign.pick_diverse(h[:5] + v[:1], 5, 10.0)
    assert [c[1] for c in chosen].count("V") == 1 and notes == ["1 of 2 V"]
    chosen, notes = assign.pick_diverse([line(i, "H", i, 0) for i in range(4)], 3, 10.0)
    assert len(chosen) == 3 and "distance relaxed" in notes
    assert assign.pick_diverse(h[:1], 3, 1.0)[1] == ["1 of 2 H", "0 of 2 V", "1 of 3 lines"]


def test_matching_rejects_decoys_and_reports_missing(spark):
    lines = [(0, 0, 100, 0), (0, 50, 80, 50), (10, 0, 10, 90), (60, 10, 60, 70), (0, 90, 120, 90)]
    f = segments.features(table(spark, lines))
    svg = [(2 * a + 10, 3 * b - 5, 2 * c + 10, 3 * d - 5) for a, b, c, d in lines[:3]] + [(2 * 60 + 10, 3 * 10 - 5, 2 * 60 + 10, 3 * 45 - 5), (300, 900, 320, 900)]
    model = spark.createDataFrame([(1, 1, 1, 2.0, 3.0, 10.0, -5.0)], "doc_id long, fx int, fy int, sx double, sy double, tx double, ty double")
    s = segments.features(table(spark, svg, "svg"))
    chosen = match.select_lines(f, s, model)
    got = {r.seg_id: r for r in match.match_lines(chosen, s, max_cost=20.0).collect()}
    assert [got[i].s_id for i in (0, 1, 2)] == [0, 1, 2] and all(got[i].pass01 == 1 for i in (0, 1, 2))
    assert got[4].s_id is None and got[4].confidence == 0.0 and got[4].pass01 is None
    assert got[3].s_id is None or got[3].pass01 == 0


def test_labels(spark):
    t = spark.createDataFrame([(1, "120 cm"), (2, "3,5 m"), (3, "no"), (4, "0 m"), (5, "12 m²")], "txt_id long, text string")
    got = {r.txt_id: r.value for r in labels.valued(t.withColumn("doc_id", F.lit(1))).collect()}
    assert got[1] == 1.2 and got[2] == 3.5 and 3 not in got and 4 not in got


def test_rasters(spark):
    p = spark.createDataFrame([(1, 0, 0, 1.0), (1, 2, 1, 1.0)], "doc_id long, row int, col int, val double")
    v = np.zeros((3, 2))
    v[0, 0] = v[2, 1] = 1
    for flip, rot in itertools.product(("none", "x", "y", "xy"), (0, 90, 180, 270)):
        w = v[:, ::-1] if "x" in flip else v
        w = np.rot90(w[::-1] if "y" in flip else w, rot // 90)
        assert {(r.row, r.col) for r in raster.turn(p, 3, 2, flip=flip, rot=rot).collect()} == set(zip(*map(list, np.nonzero(w)), strict=True))
    m = np.zeros((9, 7), bool)
    m[2, 3] = m[8, 0] = True
    d = raster.distance_map(m)
    want = [[min(math.hypot(r - 2, c - 3), math.hypot(r - 8, c)) for c in range(7)] for r in range(9)]
    assert np.allclose(d, want) and np.isinf(raster.distance_map(np.zeros((2, 2), bool))).all()
    a = np.random.default_rng(1).random((32, 48))
    assert raster.phase_shift(np.roll(a, (-5, 7), (0, 1)), a)[:2] == (7, -5)
    assert raster.product_shift(np.roll(a, (2, 3), (0, 1)), a)[:2] == (3, 2)
    assert np.allclose(raster.resized(a, 32, 48), a)
    assert profiles.fft_xcorr(np.array([0, 0, 1.0, 2]), np.array([1.0, 2, 0, 0]))[0] == 2
    assert profiles.low_pass(np.ones(8), 1.5) == pytest.approx(np.ones(8))


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("fit: {iters: 5}\n")
    c = config.load(str(f), ["fit.sigma=2.5", "new.key=[1, 2]"])
    assert c["fit"]["iters"] == 5 and c["fit"]["sigma"] == 2.5 and c["fit"]["keep"] == 40 and c["new"]["key"] == [1, 2]
    assert config.allowed_flips(" X, none,x") == ["x", "none"] and config.for_rasters(c)["select"]["pick_k"] == 1
    with pytest.raises(ValueError):
        config.override("nothing")
    with pytest.raises(ValueError):
        config.allowed_flips("z")


def test_empty_tables(spark):
    e = segments.features(table(spark, [(0, 0, 1, 0)]).where("false"))
    assert segments.axis_summary(e, "doc_id").count() == 0 and segments.merge_collinear(e).count() == 0
    assert spatial.nearest(segments.sample_steps(e, 1.0), e, 2.0).count() == 0


def test_fit_scores_on_the_reference_bound_of_points(spark, sf_dir):
    """A document of the smallest tables has more than 60 points; all of them up to 1,500 take part in the search."""
    import inspect

    from segmill.config import DEFAULTS
    from segmill.operators import fit, segments
    from segmill.sources import derived

    bound = inspect.signature(fit.fit).parameters["points"].default
    assert bound == DEFAULTS["fit"]["points"] == 1500
    pdf = segments.features(derived.segments_pdf(spark, sf_dir))
    every = {r.doc_id: r["count"] for r in segments.sample_steps(pdf, 40.0).groupBy("doc_id").count().collect()}
    assert {r.doc_id: r["count"] for r in fit._sample(pdf, bound).groupBy("doc_id").count().collect()} == {k: min(n, 1500) for k, n in every.items()}
    assert max(every.values()) > 60


def _bundles(rng, n):
    """Segments of three lengths, by which true pairs can't be told from others."""
    out = []
    for k in range(n):
        x, y, long_ = rng.randrange(0, 900), rng.randrange(0, 700), rng.choice((60, 90, 120))
        out.append((x, y, x + long_, y) if k % 2 else (x, y, x, y + long_))
    return out


def _likely(spark, docs, n=240):
    """Documents under one map whose draws seldom hit upon true pairs: both sides with features, and seeds."""
    pdf, svg = [], []
    for k in range(docs):
        data = _bundles(random.Random(k), n)
        pdf += [(k, "pdf", i, *map(float, s)) for i, s in enumerate(data)]
        svg += [(k, "svg", i, 1.01 * a + 13, 0.99 * b - 17, 1.01 * c + 13, 0.99 * d - 17) for i, (a, b, c, d) in enumerate(data) if i % 10]
    names = "doc_id long, side string, seg_id long, x1 double, y1 double, x2 double, y2 double"
    seeds = spark.createDataFrame([(k, 1.01, 0.99, 0.0, 0.0) for k in range(docs)], "doc_id long, sx0 double, sy0 double, tx0 double, ty0 double")
    return *(segments.features(spark.createDataFrame(rows, names)) for rows in (pdf, svg)), seeds


def test_fit_finds_the_shift_among_segments_of_equal_lengths(spark):
    pdf, svg, seeds = _likely(spark, 12)
    got = fit.fit(pdf, svg, seeds).collect()
    assert len(got) == 12
    assert [m.doc_id for m in got if abs(m.tx - 13) > 4 or abs(m.ty + 17) > 4 or abs(m.sx / 1.01 - 1) > 0.01 or abs(m.sy / 0.99 - 1) > 0.01] == []


def test_fit_in_a_task_and_by_joins_agree(spark, monkeypatch):
    pdf, svg, seeds = _likely(spark, 4, 120)
    pdf = pdf.where("doc_id <> 3 or seg_id < 90")
    held = {m.doc_id: m for m in fit.fit(pdf, svg, seeds).collect()}
    joined = []
    monkeypatch.setattr(fit, "_joined", lambda *a, f=fit._joined, **b: joined.append(1) or f(*a, **b))
    for most in (0, 119):  # all documents by joins; those of more than 119 segments
        monkeypatch.setattr(fit, "HELD", most)
        got = {m.doc_id: m for m in fit.fit(pdf, svg, seeds).collect()}
        assert set(got) == set(held) == {0, 1, 2, 3}
        for k, m in got.items():
            assert m[1:-1] == pytest.approx(held[k][1:-1], rel=1e-9, abs=1e-9) and m.quality_notes == held[k].quality_notes
    assert len(joined) == 2


def test_straight_polylines_keep_their_own_ends(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for k in range(60):
        a, b, c, d = (rng.uniform(0, 900) * 2 + 10 for _ in range(4))
        rows += [(k, 0, a, b), (k, 1, (a + c) / 2, (b + d) / 2), (k, 2, c, d)]
        want[k] = {(a, b), (c, d)}
    got = segments.straight(spark.createDataFrame(rows, "id int, i int, x double, y double"), "id").collect()
    assert {r.id: {(r.x1, r.y1), (r.x2, r.y2)} for r in got} == want and all(r.part == -1 for r in got)


def test_nearest_of_one_look_deals_out_few_cells(spark, monkeypatch):
    """Where cells are looked into once they are wider than the bound: half the rows at most, and the distances of brute force."""
    rng = random.Random(4)
    segs = [tuple(rng.uniform(-200, 200) for _ in range(4)) for _ in range(30)] + [(0, 0, 0, 150), (-90, 7, 90, 7), (5, 5, 5, 5)]
    spots = [(i, rng.uniform(-220, 220), rng.uniform(-220, 220)) for i in range(400)] + [(400, 0.0, 160.0), (401, 0.0, 170.0), (402, 24.0, -3.0)]
    dealt, covered = [], spatial.covered_cells
    monkeypatch.setattr(spatial, "covered_cells", lambda *a, **k: dealt.append(covered(*a, **k)) or dealt[-1])
    drawing = table(spark, segs).select(F.lit(1).alias("doc_id"), "x1", "y1", "x2", "y2")
    points = spark.createDataFrame(spots, "i int, px double, py double").select(F.lit(1).alias("doc_id"), "*")
    got = {r.i: r.d for r in spatial.nearest(points, drawing, 10.0).collect()}

    def gap(x, y, x1, y1, x2, y2):
        q = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / q)) if q else 0.0
        return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))

    assert len(got) == len(spots)
    for i, x, y in spots:
        assert abs(got[i] - min(10.0, *(gap(x, y, *s) for s in segs))) < 1e-9
    (cells,) = dealt
    monkeypatch.undo()
    assert cells.count() <= spatial.cover(drawing, 10.0).count() / 2
