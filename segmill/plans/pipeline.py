"""The whole alignment of pages with drawings, for a table of documents at once: orientation, fit, lines, matches, report.

Everything is lazy tables up to the fit, whose rounds are jobs over all documents."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.config import DEFAULTS, merged
from segmill.durable import materialize
from segmill.operators import fit, hypotheses, match, raster, segments


def oriented(pdf: DataFrame, svg: DataFrame, pages: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    """The best turn and flips of each document, scale seeds by page sizes and shift seeds. Pages of one size class share
    a job: sizes are a few distinct pairs, and each is a job of its own."""
    o = cfg["orientation"]
    both = pages.groupBy("doc_id").pivot("side", ["pdf", "svg"]).agg(F.first("w").alias("w"), F.first("h").alias("h"))
    # Unit pages: every document is scaled to one page, so that one job serves pages of all sizes.
    unit = lambda df, side: df.join(both, "doc_id").withColumns({c: F.col(c) / F.col(f"{side}_{'w' if c[0] == 'x' else 'h'}") * 1000.0 for c in ("x1", "y1", "x2", "y2")}).select("doc_id", "seg_id", "x1", "y1", "x2", "y2")
    h = hypotheses.orientation(unit(pdf, "pdf"), unit(svg, "svg"), hypotheses.flips(pdf.sparkSession), w=1000.0, h=1000.0, svg_w=1000.0, svg_h=1000.0, bins=o["bins"], size=o["size"])
    b = hypotheses.best(h, "key", "response").join(both, "doc_id")
    mirror_x, mirror_y = (F.col("fx") < 0) != (F.col("rot") == 180), (F.col("fy") < 0) != (F.col("rot") == 180)
    sx0, sy0 = F.col("svg_w") / F.col("pdf_w"), F.col("svg_h") / F.col("pdf_h")
    w = fit.windows(F.col("overlap"), o["min_overlap"], scale=cfg["refine"]["scale_max_dev_rel"], shift=cfg["refine"]["trans_max_dev_px"])
    tx0, ty0 = F.col("dx") / 1000.0 * F.col("svg_w"), F.col("dy") / 1000.0 * F.col("svg_h")
    return b.select("doc_id", "rot", "fx", "fy", mirror_x.alias("mirror_x"), mirror_y.alias("mirror_y"), "overlap", sx0.alias("sx0"), sy0.alias("sy0"), tx0.alias("tx0"), ty0.alias("ty0"), w["shift"].alias("shift_window"), w["scale"].alias("scale_window"), "pdf_w", "pdf_h")


def coarse(pdf: DataFrame, svg: DataFrame, pages: DataFrame, cfg: Mapping[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the coarse search finds (a row a document), the drawing's segments moved onto the page by it, and the pages with
    the drawing's as large as the page, for what follows. Sides have features."""
    o = cfg["coarse"]
    found = hypotheses.coarse_best(pdf, svg, bins=o["bins"], dist_tol=o["dist_tol"], angle_tol=o["angle_tol"], len_tol=o["len_tol"], shares=tuple(o["relax_topk_rel"]), tols=tuple(o["relax_hv_angle"]), least=o["min_long_segments"])
    found = materialize(found, "found")
    page = pages.where("side = 'pdf'")
    return found, hypotheses.coarse_moved(svg, found), page.unionByName(page.withColumn("side", F.lit("svg")))


def verified(models: DataFrame, pdf: DataFrame, svg: DataFrame, pages: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    """``models`` (fx, fy, sx, sy, tx, ty) with rmse, p95, median and score from the distances of the page's points to the
    drawn drawing, where the settings say ``verify.mode: distmap``."""
    if cfg["verify"]["mode"] != "distmap":
        return models
    size = int(cfg["verify"]["distmap_raster"])
    page = pages.where("side = 'svg'").select("doc_id", F.col("w").alias("_w"), F.col("h").alias("_h"))
    unit = lambda df, cols: df.join(page, "doc_id").withColumns({c: F.col(c) / F.col("_w" if "x" in c else "_h") for c in cols})
    p = segments.sample_inside(pdf, int(cfg["verify"]["distmap_samples"])).select("doc_id", "px", "py").join(models.select("doc_id", "fx", "fy", "sx", "sy", "tx", "ty"), "doc_id")
    p = p.select("doc_id", (F.col("fx") * F.col("sx") * F.col("px") + F.col("tx")).alias("px"), (F.col("fy") * F.col("sy") * F.col("py") + F.col("ty")).alias("py"))
    q = raster.distance_quality(unit(svg.select("doc_id", "x1", "y1", "x2", "y2"), ("x1", "y1", "x2", "y2")), unit(p, ("px", "py")), size=size, w=1.0, h=1.0, hard=size / 16.0)
    return models.drop("rmse", "p95", "median", "score").join(q.select("doc_id", "rmse", "p95", "median", "score"), "doc_id")


def _failures(gate: Mapping[str, Any]) -> Column:
    """What is below the gate, as texts; empty if nothing is."""
    rmse = F.when(F.col("rmse") > gate["rmse_px"], F.format_string(f"RMSE %.2fpx > {gate['rmse_px']:.2f}px", "rmse"))
    score = F.when(F.col("score") < gate["score_min"], F.format_string(f"Score %.4f < {gate['score_min']:.4f}", "score"))
    return F.filter(F.array(rmse, score), lambda n: n.isNotNull())


def calibrate(pdf: DataFrame, svg: DataFrame, pages: DataFrame, cfg: Mapping[str, Any] | None = None) -> DataFrame:
    """One model a document, as turn 0 and flips fx, fy (a half turn is both flips), by which X = fx*sx*x + tx and
    Y = fy*sy*y + ty. Sides are segment tables. The orientation sets the seed and its windows; documents whose fit is below
    the quality gate get a second fit in the gate's windows."""
    c = merged(DEFAULTS, cfg)
    tol = c["features"]["axis_tol_deg"]
    p, s = segments.features(pdf, tol), segments.features(svg, tol)
    o = materialize(oriented(p, s, pages, c), "oriented")
    # The page is mirrored first, so that the fit has positive scales; the shift takes the mirrored page's size back.
    m = p.join(o.select("doc_id", "mirror_x", "mirror_y", "pdf_w", "pdf_h"), "doc_id")
    flip = {k: F.when(F.col("mirror_x" if k[0] == "x" else "mirror_y"), F.col("pdf_w" if k[0] == "x" else "pdf_h") - F.col(k)).otherwise(F.col(k)) for k in ("x1", "y1", "x2", "y2")}
    p2 = materialize(segments.features(m.withColumns(flip).select("doc_id", "side", "seg_id", "x1", "y1", "x2", "y2"), tol), "mirrored")
    kept = segments.prefilter(p2, pages, c["features"]["min_length_rel"], c["features"]["length_ref"])
    f, gate = c["fit"], c["refine"]["quality_gate"]
    seeds = o.select("doc_id", "sx0", "sy0", "tx0", "ty0", "scale_window", "shift_window")

    def fitted(k: DataFrame, t: DataFrame, seeds: DataFrame, iters: int) -> DataFrame:
        got = fit.fit(k, t, seeds, iters=iters, keep=f["keep"], points=f["points"], sigma=f["sigma"], hard=f["hard"], seed=f["seed"], patience=f["patience"], scale=F.col("scale_window"), shift=F.col("shift_window"))
        return materialize(verified(got.drop("quality_notes"), k, t, pages, c).withColumn("failures", _failures(gate)), "fitted")

    got = fitted(kept, s, seeds, f["iters"])
    notes = F.array().cast("array<string>")
    low = got.where("size(failures) > 0").select("doc_id")
    if gate["enabled"] and low.limit(1).count():
        low = materialize(low, "low")
        some = lambda df: df.join(low, "doc_id", "left_semi")
        scale, shift = min(c["refine"]["scale_max_dev_rel"], gate["fallback_scale_max_dev_rel"]), min(c["refine"]["trans_max_dev_px"], gate["fallback_trans_max_dev_px"])
        again = fitted(some(kept), some(s), some(seeds).withColumns({"scale_window": F.lit(scale), "shift_window": F.lit(shift)}), max(1, min(f["iters"], gate["fallback_max_iters"])))
        numbers = F.format_string("RMSE=%.2fpx, P95=%.2fpx, Score=%.4f", "rmse", "p95", "score")
        said = F.when(F.size("failures") > 0, F.concat(F.lit("quality below threshold after fallback ("), numbers, F.lit("): "), F.array_join("failures", "; "))).otherwise(F.concat(F.lit("quality gate fallback succeeded ("), numbers, F.lit(")")))
        got = got.join(low, "doc_id", "left_anti").withColumn("quality_notes", notes).unionByName(again.withColumn("quality_notes", F.array(said)))
    else:
        got = got.withColumn("quality_notes", notes)
    j = got.drop("fx", "fy").join(o.select("doc_id", "mirror_x", "mirror_y", "overlap", "pdf_w", "pdf_h", "scale_window", "shift_window"), "doc_id")
    fx, fy = F.when(F.col("mirror_x"), -1).otherwise(1), F.when(F.col("mirror_y"), -1).otherwise(1)
    tx = F.col("tx") + F.when(F.col("mirror_x"), F.col("sx") * F.col("pdf_w")).otherwise(F.lit(0.0))
    ty = F.col("ty") + F.when(F.col("mirror_y"), F.col("sy") * F.col("pdf_h")).otherwise(F.lit(0.0))
    return j.select("doc_id", F.lit(0).alias("rot_deg"), fx.alias("fx"), fy.alias("fy"), "sx", "sy", tx.alias("tx"), ty.alias("ty"), "score", "rmse", "p95", "median", "overlap", "scale_window", "shift_window", "quality_notes")


def _modelled(pdf: DataFrame, svg: DataFrame, pages: DataFrame, c: Mapping[str, Any]) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    """``models``, and ``coarse`` if the settings have it on, with the features of both sides and the pages that they lead to."""
    tol = c["features"]["axis_tol_deg"]
    p, s = segments.features(pdf, tol), segments.features(svg, tol)
    if c["merge"]["enable"]:
        p = _merged(p, c, tol)
        s = _merged(s, c, tol)
    out: dict[str, DataFrame] = {}
    if c["coarse"]["enabled"]:
        out["coarse"], moved, pages = coarse(p, s, pages, c)
        s = segments.features(materialize(moved, "moved"), tol)
    out["models"] = materialize(calibrate(p.select(*pdf.columns), s.select(*svg.columns), pages, c), "models")
    return out, p, s, pages


def models(pdf: DataFrame, svg: DataFrame, pages: DataFrame, cfg: Mapping[str, Any] | None = None) -> DataFrame:
    """The ``models`` of ``run``, without the lines and matches that follow from them."""
    return _modelled(pdf, svg, pages, merged(DEFAULTS, cfg))[0]["models"]


def run(pdf: DataFrame, svg: DataFrame, pages: DataFrame, cfg: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """``models``, ``lines``, ``matches`` and ``report`` of a table of documents, and ``coarse``, what the coarse search
    found, if the settings have it on; models then lead to the drawing as that search has moved it."""
    c = merged(DEFAULTS, cfg)
    out, p, s, pages = _modelled(pdf, svg, pages, c)
    lines = materialize(match.select_lines(p, s, out["models"], k=c["select"]["pick_k"], cap=c["select"]["cap"], rel=c["select"]["diversity_rel"]), "lines")
    m = c["match"]
    matches = match.match_lines(lines, s, radius=m["radius"], neighbour_radius=m["neighbour_radius"], tol=m["tol_rel"], max_cost=m["max_cost"], neighbour_weight=m["neighbour_weight"])
    matches = materialize(matches, "matches")
    report = match.report(matches, out["models"], pages, slots=max(5, c["select"]["pick_k"]), shift_tol=c["refine"]["trans_max_dev_px"], scale_tol=c["refine"]["scale_max_dev_rel"])
    return out | {"lines": lines, "matches": matches, "report": report}


def _merged(feat: DataFrame, c: Mapping[str, Any], tol: float) -> DataFrame:
    """Snapped and merged segments with ids of their own, which follow from the segments."""
    m = segments.merge_collinear(segments.snap(feat, tol), off_tol=c["merge"]["off_tol"], gap_max=c["merge"]["gap_max"])
    m = m.withColumn("seg_id", F.abs(F.xxhash64("doc_id", "side", "x1", "y1", "x2", "y2")))
    return segments.features(m.select("doc_id", "side", "seg_id", "x1", "y1", "x2", "y2"), tol)
