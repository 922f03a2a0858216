from __future__ import annotations

import math

import pytest

from segmill import cli, sinks
from segmill.sources import svg
from segmill.streaming import incremental

from .test_operators import table


def test_transforms_nest():
    s = svg.drawing_segments('<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(10,5) scale(2)"><line x1="0" y1="0" x2="3" y2="1"/></g></svg>')
    assert s == [(10.0, 5.0, 16.0, 7.0)]
    m = svg.transform_matrix("rotate(90 1 1) nothing(3) skewX(0)")
    assert svg.apply(m, (2, 1)) == pytest.approx((1, 2))


def test_use_symbol_and_view_box():
    text = '<svg viewBox="0 0 10 10" width="20" height="20"><symbol id="s" viewBox="0 0 4 4"><line x1="0" y1="0" x2="4" y2="0"/></symbol><use href="#s" x="1" y="2" width="2" height="2"/></svg>'
    assert svg.drawing_segments(text) == [pytest.approx((2, 4, 6, 4))]
    loop = '<svg><g id="a"><use href="#a"/><line x1="0" y1="0" x2="1" y2="0"/></g></svg>'
    assert 0 < len(svg.drawing_segments(loop)) < 100


def test_path_commands():
    one = lambda d: svg.path_polylines(d)[0]
    assert one("M1 2 3 4l1 1H0V0z")[:5] == [(1, 2), (3, 4), (4, 5), (0, 5), (0, 0)]
    assert one("m1,1 2,0v2h-2z")[-1] == (1, 1)
    c = one("M0 0C0 10 10 10 10 0S20 -10 20 0")
    assert c[-1] == (20, 0) and max(y for _, y in c) == pytest.approx(7.5, abs=0.2) and min(y for _, y in c) == pytest.approx(-7.5, abs=0.2)
    q = one("M0 0Q5 10 10 0T20 0")
    assert max(y for _, y in q) == pytest.approx(5, abs=0.2) and min(y for _, y in q) == pytest.approx(-5, abs=0.2)
    a = one("M0 0A5 5 0 0 1 10 0")
    assert all(math.hypot(x - 5, y) == pytest.approx(5) for x, y in a) and len(a) > 4
    e = one("M0 0A6 3 30 1 1 8 4")
    assert e[-1] == (8, 4)
    assert svg.path_polylines("M0 0 L1") == [] and svg.path_polylines(None) == []
    assert svg.simple_path_lines("M0 0 5 5 L6 5 H9 v2 C1 1 2 2 3 3") == [[(5, 5), (6, 5)], [(6, 5), (9, 5)], [(9, 5), (9, 7)]]


def test_lengths_and_bad_input():
    assert svg.length("1in") == 96 and svg.length("50%") == 0 and svg.length("x") is None and svg.length("2.5e1px") == 25
    assert svg.drawing_segments("<svg><line") == [] and svg.drawing_segments(None) == []


def test_malformed_drawings_are_read_as_far_as_they_go():
    good = '<line x1="0" y1="0" x2="3" y2="1"/>'
    want = [(2.0, 0.0, 5.0, 1.0)]
    for text in (f'<svg viewBox="0 0 9 9"><g transform="translate(2)">{good}', f'<svg><g transform="translate(2,0)">{good}</svg></g>', f"<svg><metadata>a & b</metadata><g transform='translate(2)'>{good}</p></g></svg><", f'<?xml version="1.0"?><svg:svg xmlns:svg="x"><svg:g transform="translate(2)">{good}</svg:g><svg:line x1="1"'):
        assert svg.drawing_segments(text) == want, text
    text = '<svg viewBox="0 0 10 10" width="20"><symbol id="s" viewBox="0 0 4 4"><line x1="0" y1="0" x2="4" y2="0"/></symbol><use xlink:href="#s" x="1" y="2" width="2" height="2"/><text x="1" y="2">a<b>'
    assert svg.drawing_segments(text) == [pytest.approx((2, 4, 6, 4))] or svg.parse(text).polylines
    assert svg.parse(text).texts[0][0] == "a" and svg.parse("no drawing").polylines == []


def test_nesting_of_any_depth_and_references_in_circles():
    n = 3000
    deep = "<svg>" + '<g transform="translate(1)">' * n + '<line x1="0" y1="0" x2="1" y2="0"/>' + "</g>" * n + "</svg>"
    assert svg.drawing_segments(deep) == [(n, 0, n + 1, 0)]
    line = '<line x1="0" y1="0" x2="1" y2="0"/>'
    chain = "".join(f'<g id="g{k}">{line if k == 0 else ""}<use href="#g{k - 1}" x="1"/></g>' for k in range(1, 100))
    chain = f'<svg><defs><g id="g0">{line}</g>{chain}</defs><use href="#g99"/></svg>'
    assert svg.drawing_segments(chain) == [(99, 0, 100, 0)]
    circle = f'<svg><g id="a">{line}<use href="#b" x="5"/></g><g id="b"><use href="#a"/></g></svg>'
    assert len(svg.drawing_segments(circle)) == 3


def test_relative_tolerance_and_points():
    d = '<svg width="300" height="400"><path d="M0 200A150 150 0 0 1 300 200"/></svg>'
    fine, rough = (len(svg.drawing_segments(d, relative=r)) for r in (0.0001, 0.01))
    assert fine > 2 * rough > 4 and len(svg.drawing_segments(d, tol=5.0)) == rough


def test_dimension_edges():
    text = '<svg><g transform="scale(9)"><path d="M0 0 L1 0 L1 7 h2"/><line x1="0" y1="0" x2="5" y2="0"/></g><path d="M1 1 C 2 2 3 3 4 4"/><line x1="1" y1="1" x2="1" y2="1"/></svg>'
    assert svg.dimension_edges(text) == [(0, 0, 5, 0), (1, 0, 1, 7)] and svg.dimension_edges("") == []


def test_tables(spark, tmp_path):
    text = '<svg width="100" height="50"><rect x="1" y="1" width="2" height="3"/><text x="5" y="6" font-size="8">1,5 m</text></svg>'
    (tmp_path / "a.svg").write_text(text)
    docs = svg.read(spark, str(tmp_path / "*.svg"))
    assert svg.segments(docs).count() == 4 and svg.polylines(docs).count() == 5
    assert svg.texts(docs).first()[2:] == ("1,5 m", 5.0, 6.0, 8.0)
    assert svg.sizes(docs).first()[1:] == (75.0, 37.5)
    spark.dataSource.register(svg.SvgSource)
    assert spark.read.format("svg_segments").load(str(tmp_path / "*.svg")).count() == 4


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, '<svg><line x2="3" y2="0"/></svg>'), (2, '<svg><line x2="0" y2="4"/></svg>')], "doc_id long, svg string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    incremental.follow(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = {r.doc_id: (r.n_h, r.n_v, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (1, 0, 3.0), 2: (0, 1, 4.0)}


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 1, "a<b", (0.0, 0.0, 1.0, 0.0), None), (1, 2, None, (0.0, 0.0, 1.0, 0.0), (0.0, 1.0, 1.0, 1.0))], "doc_id long, pick int, label string, pdf struct<x1:double,y1:double,x2:double,y2:double>, svg struct<x1:double,y1:double,x2:double,y2:double>")
    pages = spark.createDataFrame([(1, "svg", 10.0, 5.0)], "doc_id long, side string, w double, h double")
    text = sinks.overlays(pairs, pages).first().svg
    assert text.count("<line") == 3 and "a&lt;b" in text and len(svg.drawing_segments(text)) == 3
    sinks.write_segments(table(spark, [(0, 0, 1, 2)]), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).first()[3] == "1.000000"


def test_command_line(spark, tmp_path):
    assert cli.main(["run", "--pdf", str(tmp_path / "none"), "--svg", "x", "--pages", "y", "--out", str(tmp_path / "o")]) == 2
    assert cli.main(["scan", "--path", str(tmp_path / "none"), "--out", str(tmp_path / "o"), "--opts", "bad"]) == 2


def test_content_streams():
    from segmill.sources import content

    one = content.content_polylines("q 2 0 0 2 0 0 cm 0 0 m 1 0 l 1 1 l s Q 0 0 4 5 re f 9 9 m 8 8 l n 1 1 m 2 2 l h B*")
    assert one[0] == [(0, 0), (2, 0), (2, 2), (0, 0)] and one[1][2] == (4, 5) and one[2] == [(1, 1), (2, 2), (1, 1)] and len(one) == 3
    curve = content.content_polylines("0 0 m 0 10 10 10 10 0 c S")[0]
    assert max(y for _, y in curve) == pytest.approx(7.5, abs=0.3) and content.content_polylines(None) == []


def test_command_line_preprocess(spark, tmp_path):
    px = [(1, side, r, c, 1.0) for side in ("pdf", "svg") for r, c in ((1, 1), (1, 2), (5, 6), (9, 3))]
    spark.createDataFrame(px, "doc_id long, side string, row long, col long, val double").write.parquet(str(tmp_path / "px"))
    table(spark, [(0, 0, 100, 0)]).write.parquet(str(tmp_path / "lines"))
    spark.createDataFrame([(1, 1, "2 m", 50.0, 5.0)], "doc_id long, txt_id long, text string, cx double, cy double").write.parquet(str(tmp_path / "texts"))
    args = ["preprocess", "--rows", "12", "--cols", "12", "--out", str(tmp_path / "out")]
    for name, folder in (("--pixels", "px"), ("--lines", "lines"), ("--texts", "texts")):
        args += [name, str(tmp_path / folder)]
    assert cli.main(args) == 0
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r.rot, r.flip) == (0, "none") and r.ncc == pytest.approx(1.0) and r.dim_x is None


def test_metrics():
    from segmill.metrics import Run

    m = Run()
    with m.stage("a"):
        pass
    m.count("n", 2)
    m.count("n")
    assert [k for k, _ in m.rows()] == ["a", "total"] and "n 3" in m.report()
