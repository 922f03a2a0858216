"""SVG drawings as tables of segments.

``segments`` and ``polylines`` read a column of SVG text with ``mapInArrow``, one document a row, so that a table of drawings
is read in parallel; ``read`` reads files. ``SvgSource`` is the same as a Spark data source, ``format("svg_segments")``."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from segmill.functions.geom import PX_TO_PT
from segmill.functions.parse import PIXELS

Point = tuple[float, float]
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

_TOKEN = re.compile(r"[MmZzLlHhVvCcSsQqTtAa]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_CALL = re.compile(r"([A-Za-z]+)\s*\(([^)]*)\)")
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """First ``n``, then ``m``."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return (a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * l + e, b * k + d * l + f)


def apply(m: Matrix, p: Point) -> Point:
    return m[0] * p[0] + m[2] * p[1] + m[4], m[1] * p[0] + m[3] * p[1] + m[5]


def transform_matrix(text: str | None) -> Matrix:
    """A transform attribute; unknown or short calls are passed over."""
    out = IDENTITY
    for name, args in _CALL.findall(text or ""):
        v = [float(x) for x in _NUMBER.findall(args)]
        if name == "matrix" and len(v) == 6:
            m = (v[0], v[1], v[2], v[3], v[4], v[5])
        elif name == "translate" and v:
            m = (1, 0, 0, 1, v[0], v[1] if len(v) > 1 else 0.0)
        elif name == "scale" and v:
            m = (v[0], 0, 0, v[1] if len(v) > 1 else v[0], 0, 0)
        elif name == "rotate" and len(v) in (1, 3):
            c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            x, y = (v[1], v[2]) if len(v) == 3 else (0.0, 0.0)
            m = (c, s, -s, c, x - c * x + s * y, y - s * x - c * y)
        elif name in ("skewX", "skewY") and len(v) == 1:
            t = math.tan(math.radians(v[0]))
            m = (1, 0, t, 1, 0, 0) if name == "skewX" else (1, t, 0, 1, 0, 0)
        else:
            continue
        out = multiply(out, m)
    return out


def view_box_matrix(box: list[float], w: float, h: float, ratio: str = "xMidYMid meet") -> Matrix:
    """Maps the view box (x, y, w, h) into a viewport: stretched for ``none``, else the whole box at one scale, placed by
    the alignment words."""
    x, y, bw, bh = box
    if bw <= 0 or bh <= 0:
        return IDENTITY
    sx, sy = w / bw, h / bh
    if ratio.strip().startswith("none"):
        return (sx, 0, 0, sy, -x * sx, -y * sy)
    s = min(sx, sy)
    share = {"Min": 0.0, "Mid": 0.5, "Max": 1.0}
    m = re.match(r"x(Min|Mid|Max)Y(Min|Mid|Max)", ratio.strip())
    ax, ay = (share[m[1]], share[m[2]]) if m else (0.5, 0.5)
    return (s, 0, 0, s, (w - bw * s) * ax - x * s, (h - bh * s) * ay - y * s)


def _flatten(p: list[Point], tol: float, out: list[Point], depth: int = 0) -> None:
    """Adds the curve of control points ``p`` without its start: halves until its control points are near the chord."""
    (x0, y0), (x1, y1) = p[0], p[-1]
    dx, dy = x1 - x0, y1 - y0
    n = math.hypot(dx, dy)
    far = max((abs((x - x0) * dy - (y - y0) * dx) / n if n > 0 else math.hypot(x - x0, y - y0)) for x, y in p[1:-1])
    if far <= tol or depth >= 18:
        out.append(p[-1])
        return
    left, right, row = [p[0]], [p[-1]], p
    while len(row) > 1:
        row = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(row, row[1:], strict=False)]
        left.append(row[0])
        right.append(row[-1])
    _flatten(left, tol, out, depth + 1)
    _flatten(right[::-1], tol, out, depth + 1)


def _arc(p: Point, rx: float, ry: float, turn: float, large: bool, sweep: bool, q: Point, tol: float, out: list[Point]) -> None:
    """An elliptical arc from ``p`` to ``q`` by its centre (SVG 1.1, F.6), in equal steps whose sagitta is within ``tol``."""
    rx, ry = abs(rx), abs(ry)
    if rx == 0 or ry == 0 or p == q:
        out.append(q)
        return
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    hx, hy = (p[0] - q[0]) / 2, (p[1] - q[1]) / 2
    x, y = c * hx + s * hy, -s * hx + c * hy
    grow = (x / rx) ** 2 + (y / ry) ** 2
    if grow > 1:
        rx, ry = rx * math.sqrt(grow), ry * math.sqrt(grow)
    under = max(0.0, ((rx * ry) ** 2 - (rx * y) ** 2 - (ry * x) ** 2) / ((rx * y) ** 2 + (ry * x) ** 2))
    k = math.sqrt(under) * (-1 if large == sweep else 1)
    cx, cy = k * rx * y / ry, -k * ry * x / rx
    start, end = math.atan2((y - cy) / ry, (x - cx) / rx), math.atan2((-y - cy) / ry, (-x - cx) / rx)
    span = end - start
    if sweep and span < 0:
        span += 2 * math.pi
    elif not sweep and span > 0:
        span -= 2 * math.pi
    r = max(rx, ry)
    step = 2 * math.acos(max(-1.0, min(1.0, 1 - tol / r))) if tol < r else math.pi / 2
    n = max(1, math.ceil(abs(span) / max(step, 1e-3)))
    mx, my = c * cx - s * cy + (p[0] + q[0]) / 2, s * cx + c * cy + (p[1] + q[1]) / 2
    for i in range(1, n):
        t = start + span * i / n
        u, v = rx * math.cos(t), ry * math.sin(t)
        out.append((c * u - s * v + mx, s * u + c * v + my))
    out.append(q)


def path_polylines(d: str | None, tol: float = 0.25) -> list[list[Point]]:
    """Polylines of a path: all commands, absolute and relative, repeated arguments, reflected control points. An
    argument that is missing ends the path."""
    tokens = _TOKEN.findall(d or "")
    out: list[list[Point]] = []
    line: list[Point] = []
    x = y = x0 = y0 = 0.0
    command, last, control = "", "", (0.0, 0.0)
    need = {"m": 2, "l": 2, "h": 1, "v": 1, "c": 6, "s": 4, "q": 4, "t": 2, "a": 7, "z": 0}
    i = 0
    while i < len(tokens):
        if tokens[i].isalpha():
            command = tokens[i]
            i += 1
        elif not command:
            break
        low, relative = command.lower(), command.islower()
        v: list[float] = []
        while len(v) < need[low] and i < len(tokens) and not tokens[i].isalpha():
            t = tokens[i]
            if low == "a" and len(v) in (3, 4) and t[0] in "01" and len(t) > 1:  # flags may be run together
                tokens[i] = t[1:]
                v.append(float(t[0]))
                continue
            v.append(float(t))
            i += 1
        if len(v) < need[low]:
            break
        ox, oy = (x, y) if relative else (0.0, 0.0)
        if low == "m":
            if len(line) > 1:
                out.append(line)
            x, y = v[0] + ox, v[1] + oy
            x0, y0, line = x, y, [(x, y)]
            command = "l" if relative else "L"
        elif low == "z":
            if line:
                line.append((x0, y0))
                out.append(line)
            x, y, line = x0, y0, [(x0, y0)]
            command = ""
        else:
            if not line:
                line = [(x, y)]
            if low == "h":
                end = (v[0] + ox, y)
                line.append(end)
            elif low == "v":
                end = (x, v[0] + oy)
                line.append(end)
            elif low == "l":
                end = (v[0] + ox, v[1] + oy)
                line.append(end)
            elif low == "a":
                end = (v[5] + ox, v[6] + oy)
                _arc((x, y), v[0], v[1], v[2], v[3] != 0, v[4] != 0, end, tol, line)
            else:
                p = [(v[k] + ox, v[k + 1] + oy) for k in range(0, len(v), 2)]
                if low == "s":
                    p.insert(0, (2 * x - control[0], 2 * y - control[1]) if last in "cs" and last else (x, y))
                elif low == "t":
                    p.insert(0, (2 * x - control[0], 2 * y - control[1]) if last in "qt" and last else (x, y))
                end = p[-1]
                _flatten([(x, y), *p], tol, line)
                control = p[-2]
            x, y = end
        last = low
    if len(line) > 1:
        out.append(line)
    return out


def simple_path_lines(d: str | None) -> list[list[Point]]:
    """Straight parts only: M, L, H and V, absolute and relative; further pairs after a move don't draw; curves and closing
    are passed over."""
    out: list[list[Point]] = []
    x = y = 0.0
    for part in re.findall(r"[A-Za-z][^A-Za-z]*", d or ""):
        c, v = part[0], [float(t) for t in _NUMBER.findall(part[1:])]
        low, rel = c.lower(), c.islower()
        if low in "ml":
            for k in range(0, len(v) - 1, 2):
                p = (v[k] + x, v[k + 1] + y) if rel else (v[k], v[k + 1])
                if low == "l":
                    out.append([(x, y), p])
                x, y = p
        elif low in "hv":
            for t in v:
                p = ((t + x if rel else t), y) if low == "h" else (x, (t + y if rel else t))
                out.append([(x, y), p])
                x, y = p
    return out


def _points(text: str | None) -> list[Point]:
    v = [float(t) for t in _NUMBER.findall(text or "")]
    return list(zip(v[::2], v[1::2], strict=False))


def _local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def length(text: str | None) -> float | None:
    """A length in pixels; percentages are 0."""
    m = re.fullmatch(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*([A-Za-z%]*)\s*", text or "")
    if not m:
        return None
    return 0.0 if m[2] == "%" else float(m[1]) * PIXELS[m[2].lower()] if m[2].lower() in PIXELS else None


@dataclass
class Drawing:
    width: float
    height: float
    polylines: list[tuple[str, list[Point]]]  # element name and points
    texts: list[tuple[str, float, float, float | None]]  # text, x, y, font size


class _Lenient(HTMLParser):
    """A tree of what can be read of a drawing that isn't well-formed: tags that close nothing are passed over, those left
    open end with their parent."""

    #: Attribute names as drawings write them; this parser gives all in lower case.
    NAMES = {"viewbox": "viewBox", "preserveaspectratio": "preserveAspectRatio", "xlink:href": "{http://www.w3.org/1999/xlink}href"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: ET.Element | None = None
        self.open: list[ET.Element] = []

    def _add(self, tag: str, attrs: list[tuple[str, str | None]]) -> ET.Element | None:
        name = tag.rsplit(":", 1)[-1]
        have = {self.NAMES.get(k, k): v or "" for k, v in attrs}
        if self.open:
            return ET.SubElement(self.open[-1], name, have)
        if self.root is None and name == "svg":
            self.root = ET.Element(name, have)
            return self.root
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = self._add(tag, attrs)
        if e is not None:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._add(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        name = tag.rsplit(":", 1)[-1]
        k = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag == name), -1)
        if k >= 0:
            del self.open[k:]

    def handle_data(self, data: str) -> None:
        if self.open:
            e = self.open[-1]
            if len(e):
                e[-1].tail = (e[-1].tail or "") + data
            else:
                e.text = (e.text or "") + data


def tree(svg: str | None) -> ET.Element | None:
    """The drawing's root element; of one that isn't well-formed, what can be read of it."""
    try:
        return ET.fromstring(svg or "")
    except ET.ParseError:
        lenient = _Lenient()
        lenient.feed(svg or "")
        lenient.close()
        return lenient.root


#: Elements whose content is drawn only where it is referred to, if at all.
_HIDDEN = frozenset("defs clipPath clippath mask pattern marker symbol".split())


def parse(svg: str | None, tol: float = 0.25, *, relative: float | None = None) -> Drawing:
    """A drawing's polylines and texts in its outermost coordinates (pixels). Curves are within ``tol`` of their chords, or
    within ``relative`` times the drawing's diagonal. References are followed to any depth, but not into themselves."""
    root = tree(svg)
    if root is None:
        return Drawing(0.0, 0.0, [], [])
    ids = {e.get("id"): e for e in root.iter() if e.get("id")}
    box = [float(t) for t in _NUMBER.findall(root.get("viewBox", ""))]
    w, h = length(root.get("width")), length(root.get("height"))
    size = (w or (box[2] if len(box) == 4 else 0.0), h or (box[3] if len(box) == 4 else 0.0))
    if relative is not None and size[0] > 0 and size[1] > 0:
        tol = relative * math.hypot(*size)
    out = Drawing(*size, [], [])

    def number(e: ET.Element, name: str) -> float:
        return length(e.get(name)) or 0.0

    def add(name: str, m: Matrix, points: list[Point]) -> None:
        if len(points) > 1:
            out.polylines.append((name, [apply(m, p) for p in points]))

    def placed(m: Matrix, e: ET.Element, by: ET.Element) -> Matrix:
        """``m`` within the view box of ``e``, whose viewport ``by`` gives."""
        inner = [float(t) for t in _NUMBER.findall(e.get("viewBox", ""))]
        if len(inner) != 4:
            return m
        return multiply(m, view_box_matrix(inner, number(by, "width") or inner[2], number(by, "height") or inner[3], e.get("preserveAspectRatio", "xMidYMid meet")))

    view = view_box_matrix(box, size[0], size[1], root.get("preserveAspectRatio", "xMidYMid meet")) if len(box) == 4 and size[0] > 0 and size[1] > 0 else IDENTITY
    # What is left to draw, the next one last: element, matrix, and the ids of the references that led to it.
    todo: list[tuple[ET.Element, Matrix, frozenset[str]]] = [(root, view, frozenset())]
    while todo:
        e, m, chain = todo.pop()
        name = _local(e.tag)
        if name in _HIDDEN:
            continue
        m = multiply(m, transform_matrix(e.get("transform")))
        if name == "svg" and e is not root:
            m = placed(m, e, e)
        if name == "line":
            add(name, m, [(number(e, "x1"), number(e, "y1")), (number(e, "x2"), number(e, "y2"))])
        elif name in ("polyline", "polygon"):
            p = _points(e.get("points"))
            add(name, m, p + p[:1] if name == "polygon" else p)
        elif name == "rect":
            x, y, rw, rh = (number(e, k) for k in ("x", "y", "width", "height"))
            if rw > 0 and rh > 0:
                add(name, m, [(x, y), (x + rw, y), (x + rw, y + rh), (x, y + rh), (x, y)])
        elif name == "path":
            for p in path_polylines(e.get("d"), tol):
                add(name, m, p)
        elif name == "text":
            x, y = apply(m, (number(e, "x"), number(e, "y")))
            out.texts.append(("".join(e.itertext()).strip(), x, y, length(e.get("font-size"))))
        elif name == "use":
            ref = (e.get("href") or e.get("{http://www.w3.org/1999/xlink}href") or "").removeprefix("#")
            target = ids.get(ref)
            if target is not None and ref not in chain:
                at = multiply(m, (1, 0, 0, 1, number(e, "x"), number(e, "y")))
                if _local(target.tag) == "symbol":
                    at = placed(at, target, e)
                    todo += [(c, at, chain | {ref}) for c in reversed(target)]
                else:
                    todo.append((target, at, chain | {ref}))
        elif name in ("g", "svg", "a", "switch"):
            todo += [(c, m, chain) for c in reversed(e)]
    return out


def drawing_segments(svg: str | None, tol: float = 0.25, *, relative: float | None = None) -> list[tuple[float, float, float, float]]:
    """Every edge of every polyline, without those of no length."""
    return [(*a, *b) for _, p in parse(svg, tol, relative=relative).polylines for a, b in zip(p, p[1:], strict=False) if a != b]


def dimension_edges(svg: str | None) -> list[tuple[float, float, float, float]]:
    """Lines that may carry a dimension, in their own coordinates, without transforms: every line element, then the longest
    straight part of each path (the first of equals)."""
    root = tree(svg)
    if root is None:
        return []
    out, value = [], lambda e, k: length(e.get(k)) or 0.0
    for e in root.iter():
        if _local(e.tag) == "line":
            out.append(tuple(value(e, k) for k in ("x1", "y1", "x2", "y2")))
    for e in root.iter():
        if _local(e.tag) == "path" and (parts := simple_path_lines(e.get("d"))):
            (x1, y1), (x2, y2) = max(parts, key=lambda p: math.dist(*p))
            out.append((x1, y1, x2, y2))
    return [s for s in out if s[:2] != s[2:]]


def _edges(docs: DataFrame, id_col: str, svg: str, run_one: Callable[[str | None], list[tuple[float, float, float, float]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = run_one(text)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(s), pa.int64()), pa.array(range(len(s)), pa.int64()), *(pa.array([t[k] for t in s], pa.float64()) for k in range(4))], ["doc_id", "seg_id", "x1", "y1", "x2", "y2"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(svg).alias("svg")).mapInArrow(run, "doc_id long, seg_id long, x1 double, y1 double, x2 double, y2 double")


def segments(docs: DataFrame, *, id_col: str = "doc_id", svg: str = "svg", tol: float = 0.25, relative: float | None = None, to_points: bool = False) -> DataFrame:
    """doc_id, seg_id (from 0 in each drawing), x1, y1, x2, y2 of the drawings in a column of text, in pixels or, with
    ``to_points``, in points (72 to the inch)."""
    s = _edges(docs, id_col, svg, lambda text: drawing_segments(text, tol, relative=relative))
    return s.withColumns({c: F.col(c) * PX_TO_PT for c in ("x1", "y1", "x2", "y2")}) if to_points else s


def dimension_segments(docs: DataFrame, *, id_col: str = "doc_id", svg: str = "svg") -> DataFrame:
    """doc_id, seg_id, x1, y1, x2, y2 of ``dimension_edges``."""
    return _edges(docs, id_col, svg, dimension_edges)


def polylines(docs: DataFrame, *, id_col: str = "doc_id", svg: str = "svg", tol: float = 0.25, relative: float | None = None) -> DataFrame:
    """doc_id, poly_id, kind, i, x, y: the points of each polyline, for line fits and straightness tests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(k, name, i, *p) for k, (name, line) in enumerate(parse(text, tol, relative=relative).polylines) for i, p in enumerate(line)]
                col = lambda k, t, r=rows: pa.array([x[k] for x in r], t)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.int64()), col(0, pa.int32()), col(1, pa.string()), col(2, pa.int32()), col(3, pa.float64()), col(4, pa.float64())], ["doc_id", "poly_id", "kind", "i", "x", "y"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(svg).alias("svg")).mapInArrow(run, "doc_id long, poly_id int, kind string, i int, x double, y double")


def texts(docs: DataFrame, *, id_col: str = "doc_id", svg: str = "svg") -> DataFrame:
    """doc_id, txt_id, text, x, y, font of the text elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = parse(text).texts
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(t), pa.int64()), pa.array(range(len(t)), pa.int64()), pa.array([r[0] for r in t], pa.string()), *(pa.array([r[k] for r in t], pa.float64()) for k in (1, 2, 3))], ["doc_id", "txt_id", "text", "x", "y", "font"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(svg).alias("svg")).mapInArrow(run, "doc_id long, txt_id long, text string, x double, y double, font double")


def sizes(docs: DataFrame, *, id_col: str = "doc_id", svg: str = "svg", to_points: bool = True) -> DataFrame:
    """doc_id, w, h of the drawings, in points (pixels times 72/96) or pixels."""
    k = 0.75 if to_points else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [parse(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.width * k for x in d], pa.float64()), pa.array([x.height * k for x in d], pa.float64())], ["doc_id", "w", "h"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(svg).alias("svg")).mapInArrow(run, "doc_id long, w double, h double")


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_id (a hash of the path) and svg of the files at ``path``, through Spark's own readers."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.xxhash64("path").alias("doc_id"), F.decode("content", "utf-8").alias("svg"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.tol = options.get("path", ""), float(options.get("tol", "0.25"))

    def partitions(self) -> list[InputPartition]:
        import glob

        return [_File(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            for k, s in enumerate(drawing_segments(f.read(), self.tol)):
                yield (partition.path, k, *s)


class SvgSource(DataSource):
    """``spark.dataSource.register(SvgSource)``, then ``spark.read.format("svg_segments").load(glob)``: a partition for each
    file, for files that every executor can open; elsewhere use ``read`` with ``segments``."""

    @classmethod
    def name(cls) -> str:
        return "svg_segments"

    def schema(self) -> str:
        return "path string, seg_id long, x1 double, y1 double, x2 double, y2 double"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)
