"""Page files: objects in every form, turned and cut pages, forms, damage, single pages, overlays; drawn pages."""

from __future__ import annotations

import base64
import math
import zlib
from xml.etree import ElementTree

import pytest

from segmill import sinks
from segmill.operators import raster
from segmill.sources import pdf

CONTENT = b"q 1 0 0 1 10 10 cm 0 0 m 100 0 l S Q (a m 5 5 l S \\) x) Tj /F1 Do BT /F 12 Tf 20 30 Td [(he) -20 (llo) <2128>] TJ 0 -14 TD (two) ' ET BI /W 1 ID \x01 m l S EI 5 5 20 20 re f"


def file(page: bytes = b"", content: bytes = CONTENT, head: bytes = b"", more: bytes = b"") -> bytes:
    return (
        b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R 9 0 R]/MediaBox[0 0 200 100]/Resources<</XObject<</F1 5 0 R>>>>/Count 1>>endobj "
        b"3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R" + page + b">>endobj 4 0 obj<<" + head + b"/Length " + str(len(content)).encode() + b">>stream\n" + content + b"\nendstream endobj "
        b"5 0 obj<</Subtype/Form/Matrix[1 0 0 1 7 7]/Length 99>>stream\n0 0 m 0 50 l S /F1 Do\nendstream endobj " + more
    )


def lines(data: bytes, k: int = 0):
    f = pdf.File(data)
    return [[tuple(round(v, 6) for v in p) for p in line] for line in f.lines(f.pages[k])]


WANT = [[(10, 10), (110, 10)], [(7, 7), (7, 57)], [(5, 5), (25, 5), (25, 25), (5, 25), (5, 5)]]


def test_lines_and_texts():
    f = pdf.File(file())
    assert len(f.pages) == 1 and f.placed(f.pages[0])[:2] == (200, 100) and lines(file()) == WANT
    assert [(t, round(x, 6), round(y, 6), s) for t, x, y, s in f.texts(f.pages[0])][1:] == [("hello!(", 20, 30, 12), ("two", 20, 2, 12)]


@pytest.mark.parametrize("turn,want", [(0, ((10, 10), (110, 10))), (90, ((10, 190), (10, 90))), (180, ((190, 90), (90, 90))), (270, ((90, 10), (90, 110))), (-90, ((90, 10), (90, 110)))])
def test_turned_pages_and_what_is_drawn_over_them(turn, want):
    data = file(b"/Rotate %d" % turn)
    assert lines(data)[0] == list(want)
    assert lines(pdf.single(pdf.File(data), 0, b"1 2 m 3 4 l S"))[-1] == [(1, 2), (3, 4)]


def test_cut_page():
    f = pdf.File(file(b"/CropBox[10 5 500 60]"))
    assert f.placed(f.pages[0])[:2] == (190, 55) and lines(file(b"/CropBox[10 5 500 60]"))[0] == [(0, 5), (100, 5)]


def test_codings():
    z = zlib.compress(CONTENT)
    assert lines(file(content=z, head=b"/Filter/FlateDecode")) == WANT
    assert lines(file(content=base64.a85encode(z) + b"~>", head=b"/Filter[/ASCII85Decode/FlateDecode]")) == WANT
    assert lines(file(content=CONTENT.hex().encode() + b">", head=b"/Filter/ASCIIHexDecode")) == WANT
    with pytest.raises(pdf.Unreadable):
        lines(file(content=z[3:], head=b"/Filter/FlateDecode"))


def test_predicted_rows():
    plain = bytes(range(1, 13))
    rows = [plain[0:4], plain[4:8], plain[8:12]]
    left = lambda r: bytes([r[0], *((r[i] - r[i - 1]) & 255 for i in range(1, 4))])
    coded = b"\x00" + rows[0] + b"\x01" + left(rows[1]) + b"\x02" + bytes((b - a) & 255 for a, b in zip(rows[1], rows[2], strict=True))
    assert pdf._unpredicted(coded, 4) == plain


def test_objects_within_streams_and_updates():
    inner = b"1 0 2 33 <</Type/Catalog/Pages 2 0 R>>    <</Type/Pages/Kids[3 0 R]/MediaBox[0 0 50 60]>>"
    packed = b"7 0 obj<</Type/ObjStm/N 2/First 9/Length %d>>stream\n%b\nendstream endobj 3 0 obj<</Type/Page/Contents 4 0 R>>endobj 4 0 obj<</Length 99>>stream\n0 0 m 1 1 l S\nendstream endobj"
    data = packed % (len(inner), inner.replace(b"33", b"%02d" % (inner.index(b"<</Type/Pages") - 9)))
    f = pdf.File(data)
    assert f.placed(f.pages[0])[:2] == (50, 60) and lines(data) == [[(0, 0), (1, 1)]]
    assert lines(data + b" 4 0 obj<</Length 3>>stream\n2 2 m 3 3 l S\nendstream endobj trailer<</Root 1 0 R>>") == [[(2, 2), (3, 3)]]


@pytest.mark.parametrize("data", [None, b"", b"junk obj 1 0 obj", b"1 0 obj<</Type/Catalog/Pages 1 0 R", b"1 0 obj 1 0 R endobj", file(more=b"trailer<</Root 1 0 R/Encrypt 5 0 R>>"), b"1 0 obj" + b"[" * 5000])
def test_unreadable(data):
    with pytest.raises(pdf.Unreadable):
        pdf.File(data)


def test_single_pages_hold_what_they_use():
    two = b"9 0 obj<</Type/Page/Parent 2 0 R/Contents[4 0 R 10 0 R]/Next 3 0 R>>endobj 10 0 obj<</Length 13>>stream\n0 0 m 9 9 l S\nendstream endobj"
    f = pdf.File(file(more=two))
    one = pdf.File(pdf.single(f, 1))
    assert len(f.pages) == 2 and len(one.pages) == 1 and one.lines(one.pages[0]) == f.lines(f.pages[1])
    assert one.get(one.pages[0]["Next"]) is None
    with pytest.raises(ValueError):
        pdf.single(f, 2)
    at = int(pdf.single(f, 1).split(b"startxref\n")[1].split()[0])
    assert pdf.single(f, 1)[at:].startswith(b"xref\n0 ")


def test_odd_operands():
    far = b"9" * 5000
    assert lines(file(content=b"[1] Do (x) Do 0 0 m 1 1 l S")) == [[(0, 0), (1, 1)]]
    assert lines(file(b"/Rotate " + far, content=b"0 0 m " + far + b" 1 l S"))[0][0] is not None
    assert pdf.File(file(more=far + b" 0 obj 1 endobj")).pages
    deep = pdf.File(file(b"/Group 7 0 R", more=b"7 0 obj" + b"[" * 5000 + b"]" * 5000 + b"endobj"))
    with pytest.raises(pdf.Unreadable):
        pdf.single(deep, 0)


def test_tables(spark):
    hidden = file(content=b"xx", head=b"/Filter/LZWDecode")
    rows = [(1, bytearray(file())), (2, None), (3, bytearray(b"")), (4, bytearray(hidden)), (1, bytearray(file()))]
    files = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, pdf binary, page_index string, error int")
    got = {(r.doc_id, r.page_index, r.w, r.error) for r in pdf.pages(files).collect()}
    assert got == {(1, 0, 200.0, None), (2, None, None, "no pages"), (3, None, None, "no pages"), (4, 0, 200.0, "coding LZWDecode")}
    assert [r.doc_id for r in pdf.segments(files).collect()] == [1] * 12
    assert pdf.segments(files, page=1).count() == 0 and pdf.segments(files.limit(0)).count() == 0
    svg = pdf.drawings(files).first().svg
    assert len(ElementTree.fromstring(svg)) == 6 and "hello!(" in svg
    none = spark.createDataFrame([], "doc_id long, pick int, x1 double, y1 double, x2 double, y2 double, matched boolean")
    assert [r.doc_id for r in pdf.overlaid(files, none).collect()] == [1, 1]


def test_marks_on_pages(spark):
    files = spark.createDataFrame([(1, bytearray(file()))], "doc_id long, pdf binary")
    chosen = spark.createDataFrame([(1, 2, 0.0, 0.0, 10.0, 0.0, False), (1, 1, 0.0, 5.0, 10.0, 5.0, True)], "doc_id long, pick int, x1 double, y1 double, x2 double, y2 double, matched boolean")
    models = spark.createDataFrame([(1, 180, 1, -1, 1.5, 2.0, 3.0, 4.0)], "doc_id long, rot_deg int, fx int, fy int, sx double, sy double, tx double, ty double")
    said = sinks.notes(models, tol=2.0)
    f = pdf.File(bytes(pdf.overlaid(files, chosen, said).first().pdf))
    words = [t for t, *_ in f.texts(f.pages[0])]
    assert words[3:] == ["1", "2 (no match)", *said.first().text.split("\n")] and "(tol 2.000px via config)" in words[-1] and "|t|=5.000px" in words[-1]
    pages = spark.createDataFrame([(1, "svg", 20.0, 10.0)], "doc_id long, side string, w double, h double")
    seg = "struct<x1: double, y1: double, x2: double, y2: double>"
    pairs = spark.createDataFrame([(1, 1, "1", (0.0, 0.0, 1.0, 1.0), None), (7, 1, "1", (0.0, 0.0, 1.0, 1.0), None)], f"doc_id long, pick int, label string, pdf {seg}, svg {seg}")
    root = ElementTree.fromstring(sinks.overlays(pairs, pages, said).first().svg)
    box = next(e for e in root.iter() if e.get("id") == "CHECK_METADATA")
    assert [e.text for e in box if e.tag.endswith("text")] == said.first().text.split("\n")
    assert "CHECK_METADATA" not in sinks.overlays(pairs, pages, said.where("doc_id = 2")).first().svg


def test_drawn_pages(spark):
    pages = spark.createDataFrame([(1, 20.0, 10.0), (2, 3.2, 0.1), (3, 5.0, 5.0)], "doc_id long, w double, h double")
    segs = spark.createDataFrame([(1, -1e12, 5.0, 1e12, 5.0), (1, 3.0, 30.0, 3.0, -30.0), (1, 30.0, 0.0, 30.0, 9.0), (1, None, 0.0, 1.0, 1.0), (2, 0.0, 0.05, 3.2, 0.05), (9, 0.0, 0.0, 1.0, 1.0)], "doc_id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.doc_id, r.row, r.col) for r in raster.render(segs, pages, zoom=1.0).collect()}
    one = {(r, c) for d, r, c in got if d == 1}
    assert {c for r, c in one if r == 5} == set(range(20)) and {r for r, c in one if c == 3} == set(range(10)) and len(one) == 29
    assert {(r, c) for d, r, c in got if d == 2} <= {(0, c) for c in range(4)} and {d for d, _, _ in got} == {1, 2}
    small = raster.render(segs, pages, size=40, y_up=False).where("doc_id = 1")
    assert math.isclose(small.agg({"col": "max"}).first()[0], 39) and small.agg({"row": "max"}).first()[0] <= 19
    cut = raster.preview(raster.render(segs, pages, zoom=1.0), spark.createDataFrame([(1, 3, 1, 5, 4)], "doc_id long, row0 int, col0 int, row1 int, col1 int"), margin=1)
    assert {(r.row, r.col) for r in cut.collect()} == {(r - 2, c) for r, c in one if 2 <= r <= 6 and c <= 5}
    for wrong in ({}, {"zoom": 1.0, "size": 3}, {"zoom": 0.0}):
        with pytest.raises(ValueError):
            raster.render(segs, pages, **wrong)


def test_dimension_drawings(spark):
    pages = spark.createDataFrame([(1, 20.0, 10.0), (2, 5.0, 5.0)], "doc_id long, w double, h double")
    lines = spark.createDataFrame([(1, 0.0, 0.0, 8.0, 0.0)], "doc_id long, x1 double, y1 double, x2 double, y2 double")
    texts = spark.createDataFrame([(1, 2.0, 2.0, 3.0, 1.0)], "doc_id long, bx double, by double, bw double, bh double")
    links = spark.createDataFrame([(1, 0.0, 0.0, 8.0, 0.0, 3.5, 2.5, True)], "doc_id long, x1 double, y1 double, x2 double, y2 double, cx double, cy double, inlier boolean")
    got = {r.doc_id: ElementTree.fromstring(r.svg) for r in sinks.dimension_drawings(lines, texts, links, pages).collect()}
    assert [e.tag.split("}")[1] for e in got[1]] == ["rect", "line", "rect", "line", "line"] and len(got[2]) == 1


def test_command(spark, tmp_path):
    from segmill import cli

    (tmp_path / "a.pdf").write_bytes(file())
    assert cli.main(["pages", "--path", str(tmp_path / "*.pdf"), "--page", "0", "--out", str(tmp_path / "out")]) == 0
    count = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).count()
    assert [count(n) for n in ("pages", "segments", "texts", "drawings")] == [1, 6, 3, 1]
    assert cli.main(["pages", "--path", str(tmp_path / "none"), "--out", str(tmp_path / "out")]) == 2
