"""Outputs: the report as CSV, segments as CSV, overlays as SVG text, and tables as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions import geom


def write_report(report: DataFrame, path: str, *, single: bool = False) -> None:
    """CSV with a header, in the order of document and line; one file only if that is the wish, for small reports."""
    df = report.coalesce(1) if single else report
    df.sortWithinPartitions("doc_id", "id").write.mode("overwrite").option("header", True).csv(path)


def write_segments(segs: DataFrame, path: str) -> None:
    """x1, y1, x2, y2 with six digits, by document."""
    segs.select("doc_id", *[geom.fixed(F.col(c), 6).alias(c) for c in ("x1", "y1", "x2", "y2")]).write.mode("overwrite").option("header", True).csv(path)


def write_debug(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _tag(name: str, **attributes: Column | str) -> Column:
    """An element without content; attribute names use ``_`` for ``-``."""
    parts: list[Column] = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        parts += [F.lit(f' {k.replace("_", "-")}="'), v if isinstance(v, Column) else F.lit(v), F.lit('"')]
    return F.concat(*parts, F.lit("/>"))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def notes(models: DataFrame, *, tol: float | None = None, source: str = "config") -> DataFrame:
    """doc_id, text: lines that say what a model is, for overlays of drawings and pages."""
    shift = geom.norm(F.col("tx"), F.col("ty"))
    first = F.format_string("rot=%d° | flips=%s | sx=%.6f | sy=%.6f", F.pmod(F.col("rot_deg").cast("int"), F.lit(360)), geom.flip_name(F.col("fx"), F.col("fy")), "sx", "sy")
    second = F.format_string("tx=%.3fpx | ty=%.3fpx | |t|=%.3fpx", "tx", "ty", shift)
    return models.select("doc_id", F.concat(first, F.lit("\n"), second, F.lit("" if tol is None else f" (tol {tol:.3f}px via {source})")).alias("text"))


#: Colours of chosen lines and of their matches.
PAGE_LINE, DRAWING_LINE = "#F44336", "#2979FF"
#: The box of notes on a drawing, its place, padding, line height, width of a letter, and look.
BOX_AT, BOX_PAD, BOX_LINE, BOX_LETTER = 18, (12, 8), 16, 6.4
BOX_LOOK = {"rx": "6.0", "ry": "6.0", "fill": "#FFFFFF", "stroke": "#212121", "stroke_width": "0.8", "opacity": "0.96"}


def overlays(pairs: DataFrame, pages: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """One SVG text a document: a group CHECK_LINES with a line for each chosen segment, one for its match, and a label.
    ``pairs`` has doc_id, pick, label, pdf and svg (structs x1, y1, x2, y2; svg may be null), in drawing coordinates. ``said``
    (doc_id, text) puts lines of text in a box, group CHECK_METADATA, and in a comment."""
    at = lambda s: {k: geom.fixed(F.col(f"{s}.{k}"), 3) for k in ("x1", "y1", "x2", "y2")}
    label = F.concat(F.lit('<text x="'), geom.fixed((F.col("pdf.x1") + F.col("pdf.x2")) / 2, 3), F.lit('" y="'), geom.fixed((F.col("pdf.y1") + F.col("pdf.y2")) / 2, 3), F.lit('" font-size="8">'), _escaped(F.coalesce(F.col("label"), F.lit(""))), F.lit("</text>"))
    part = F.concat(_tag("line", **at("pdf"), stroke=PAGE_LINE), F.when(F.col("svg").isNotNull(), _tag("line", **at("svg"), stroke=DRAWING_LINE, stroke_dasharray="4 2")).otherwise(F.lit("")), label)
    body = pairs.select("doc_id", "pick", part.alias("part")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pick", "part"))).alias("a"))
    size = pages.where("side = 'svg'").select("doc_id", "w", "h")
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), geom.fixed(F.col("w"), 3), F.lit(" "), geom.fixed(F.col("h"), 3), F.lit('"><g id="CHECK_LINES" fill="none">'))
    j, box = body.join(size, "doc_id"), F.lit("")
    if said is not None:
        j = j.join(said.select("doc_id", F.split("text", "\n").alias("_said")), "doc_id", "left")
        wide, high = 2 * BOX_PAD[0] + BOX_LETTER * F.array_max(F.transform("_said", F.length)), 2 * BOX_PAD[1] + BOX_LINE * F.size("_said")
        line = lambda t, k: F.concat(F.lit(f'<text x="{BOX_AT + BOX_PAD[0]}" y="'), (F.lit(BOX_AT + BOX_PAD[1]) + BOX_LINE * k).cast("string"), F.lit('" font-size="12" fill="#000000" dominant-baseline="hanging">'), _escaped(t), F.lit("</text>"))
        comment = F.regexp_replace(F.array_join("_said", " | "), "-(?=-|$)", "")
        box = F.concat(F.lit('<g id="CHECK_METADATA"><!-- '), comment, F.lit(" -->"), _tag("rect", x=str(BOX_AT), y=str(BOX_AT), width=geom.fixed(wide, 3), height=geom.fixed(high.cast("double"), 3), **BOX_LOOK), F.array_join(F.transform("_said", line), ""), F.lit("</g>"))
        box = F.coalesce(box, F.lit(""))
    return j.select("doc_id", F.concat(head, box, F.array_join(F.transform("a", lambda x: x["part"]), ""), F.lit("</g></svg>")).alias("svg"))


def dimension_drawings(lines: DataFrame, texts: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, svg: what a search for dimensions saw. ``lines`` (doc_id, x1, y1, x2, y2) in gray, ``texts`` as boxes (doc_id,
    bx, by, bw, bh), and for each of ``links`` (x1, y1, x2, y2 of the line, cx, cy of its label, inlier) a dashed link from
    the line's middle to the label and, if it is an inlier, the line in green. ``pages`` has doc_id, w, h. A document's parts
    are joined into one text, so this is for drawings that are looked at, not for all."""
    at = {k: geom.fixed(F.col(k), 3) for k in ("x1", "y1", "x2", "y2")}
    middle = {"x1": geom.fixed((F.col("x1") + F.col("x2")) / 2, 3), "y1": geom.fixed((F.col("y1") + F.col("y2")) / 2, 3), "x2": geom.fixed(F.col("cx"), 3), "y2": geom.fixed(F.col("cy"), 3)}
    link = F.concat(_tag("line", **middle, stroke="#ffd500", stroke_width="0.5", stroke_dasharray="2,2"), F.when(F.col("inlier"), _tag("line", **at, stroke="#00ff88", stroke_width="1.2")).otherwise(F.lit("")))
    box = _tag("rect", x=geom.fixed(F.col("bx"), 3), y=geom.fixed(F.col("by"), 3), width=geom.fixed(F.col("bw"), 3), height=geom.fixed(F.col("bh"), 3), fill="none", stroke="#ffffff", stroke_width="0.5")
    parts = lines.select("doc_id", F.lit(0).alias("k"), _tag("line", **at, stroke="#bbbbbb", stroke_width="0.6").alias("part")).unionByName(texts.select("doc_id", F.lit(1).alias("k"), box.alias("part"))).unionByName(links.select("doc_id", F.lit(2).alias("k"), link.alias("part")))
    body = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("a"))
    size = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), geom.fixed(F.col("w"), 3), F.lit(" "), geom.fixed(F.col("h"), 3), F.lit('"><rect width="100%" height="100%" fill="#000000"/>'))
    return pages.select("doc_id", "w", "h").join(body, "doc_id", "left").select("doc_id", F.concat(size, F.coalesce(F.array_join(F.transform("a", lambda x: x["part"]), ""), F.lit("")), F.lit("</svg>")).alias("svg"))


def summary(models: DataFrame, matches: DataFrame) -> DataFrame:
    """A line of text a document: how many lines passed, and the model."""
    m = matches.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("pass01") == 1).alias("passed"))
    j = models.join(m, "doc_id", "left")
    return j.select("doc_id", F.format_string("%d of %d lines pass; sx=%.6f sy=%.6f tx=%.3f ty=%.3f flip=%s", F.coalesce("passed", F.lit(0)), F.coalesce("lines", F.lit(0)), "sx", "sy", "tx", "ty", geom.flip_name(F.col("fx"), F.col("fy"))).alias("text"))
