"""Straight lines of page content streams: the drawing operators of a page description, with a matrix stack."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .svg import IDENTITY, Matrix, Point, _flatten, apply, multiply

_TOKEN = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z*'\"]+")


def content_polylines(text: str | None, tol: float = 0.25) -> list[list[Point]]:
    """Polylines that a stream paints: m, l, c, v, y, h and re build a path, S, s, f, F, B, b and their starred forms paint
    it, n drops it, q, Q and cm keep the matrix. Other operators are passed over."""
    out: list[list[Point]] = []
    stack: list[Matrix] = []
    m, path, args = IDENTITY, [], []

    def paint(close: bool) -> None:
        for p in path:
            if close and p[0] != p[-1]:
                p.append(p[0])
            if len(p) > 1:
                out.append([apply(m, q) for q in p])
        path.clear()

    for t in _TOKEN.findall(text or ""):
        if t[0] in "+-.0123456789":
            args.append(float(t))
            continue
        v, args = args, []
        if t == "m" and len(v) >= 2:
            path.append([(v[-2], v[-1])])
        elif t == "l" and len(v) >= 2 and path:
            path[-1].append((v[-2], v[-1]))
        elif t in ("c", "v", "y") and path and len(v) >= (6 if t == "c" else 4):
            start = path[-1][-1]
            p = [(v[i], v[i + 1]) for i in range(0, len(v) - 1, 2)]
            control = p if t == "c" else [start, *p] if t == "v" else [p[0], p[1], p[1]]
            _flatten([start, *control], tol, path[-1])
        elif t == "h" and path:
            path[-1].append(path[-1][0])
        elif t == "re" and len(v) >= 4:
            x, y, w, h = v[-4:]
            path.append([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])
        elif t == "cm" and len(v) >= 6:
            m = multiply(m, tuple(v[-6:]))
        elif t == "q":
            stack.append(m)
        elif t == "Q" and stack:
            m = stack.pop()
        elif t in ("S", "f", "F", "B", "f*", "B*"):
            paint(False)
        elif t in ("s", "b", "b*"):
            paint(True)
        elif t == "n":
            path.clear()
    return out


def segments(pages: DataFrame, *, id_col: str = "doc_id", content: str = "content", tol: float = 0.25) -> DataFrame:
    """doc_id, seg_id, x1, y1, x2, y2 of the streams in a column of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = [(*a, *b) for p in content_polylines(text, tol) for a, b in zip(p, p[1:], strict=False) if a != b]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(s), pa.int64()), pa.array(range(len(s)), pa.int64()), *(pa.array([t[k] for t in s], pa.float64()) for k in range(4))], ["doc_id", "seg_id", "x1", "y1", "x2", "y2"])

    return pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content).alias("content")).mapInArrow(run, "doc_id long, seg_id long, x1 double, y1 double, x2 double, y2 double")
