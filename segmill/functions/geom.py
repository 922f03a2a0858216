"""Column functions of line segments and points. Segments are four columns, by default x1, y1, x2, y2.

Lengths are square roots of sums of squares, not ``hypot``, so that other engines give the same bits."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

PX_TO_PT = 72.0 / 96.0


class Seg(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def seg(prefix: str = "", suffix: str = "") -> Seg:
    return Seg(*(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")))


def norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def length(s: Seg) -> Column:
    return norm(s.x2 - s.x1, s.y2 - s.y1)


def length_eps(s: Seg, eps: float = 1e-9) -> Column:
    """A length that is safe to divide by."""
    return length(s) + eps


def angle(s: Seg) -> Column:
    """Direction in degrees, -180 to 180."""
    return F.degrees(F.atan2(s.y2 - s.y1, s.x2 - s.x1))


def angle180(s: Seg) -> Column:
    """Direction of the line in degrees, from 0 to below 180; 0 for a point."""
    flat = (s.x1 == s.x2) & (s.y1 == s.y2)
    return F.when(flat, F.lit(0.0)).otherwise(F.pmod(angle(s), F.lit(180.0)))


def center(s: Seg) -> tuple[Column, Column]:
    return (s.x1 + s.x2) / 2, (s.y1 + s.y2) / 2


def direction(s: Seg) -> tuple[Column, Column]:
    """Unit vector; (1, 0) for a point."""
    n = length(s)
    return F.when(n > 0, (s.x2 - s.x1) / n).otherwise(F.lit(1.0)), F.when(n > 0, (s.y2 - s.y1) / n).otherwise(F.lit(0.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Difference of two line directions in degrees, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def axis(a: Column, tol: float | Column = 2.0) -> Column:
    """H, V or null for a direction in [0, 180)."""
    h, v = F.least(a, 180 - a), F.abs(a - 90)
    return F.when((h <= tol) & (h <= v), "H").when(v <= tol, "V")


def axis_code(a: Column, tol: float = 0.5) -> Column:
    """0 for H, 1 for V, -1 for neither."""
    return F.when(F.least(a, 180 - a) <= tol, 0).when(F.abs(a - 90) <= tol, 1).otherwise(-1)


def dominant_axis(s: Seg) -> Column:
    return F.when(F.abs(s.x2 - s.x1) >= F.abs(s.y2 - s.y1), "H").otherwise("V")


def axis_or_dominant(s: Seg, tol: float = 2.0) -> Column:
    return F.coalesce(axis(angle180(s), tol), dominant_axis(s))


def loose_orientation(s: Seg, tol: float = 10.0) -> Column:
    """h, v or diag for lines of a drawing, by strict bounds."""
    a = F.abs(angle(s))
    return F.when((a < tol) | (F.abs(a - 180) < tol), "h").when(F.abs(a - 90) < tol, "v").otherwise("diag")


def hv_mask(s: Seg, tol_deg: float) -> tuple[Column, Column]:
    """Two independent flags, in radians."""
    a = F.pmod(F.atan2(s.y2 - s.y1, s.x2 - s.x1), F.pi())
    tol = F.radians(F.lit(tol_deg))
    return F.least(a, F.pi() - a) <= tol, F.abs(a - F.pi() / 2) <= tol


def snapped(s: Seg, tol: float = 2.0) -> Seg:
    """Ends on the axis that the segment nearly follows: ordered, with their mean other coordinate."""
    k = axis(angle180(s), tol)
    mx, my = center(s)
    pick = lambda h, v, o: F.when(k == "H", h).when(k == "V", v).otherwise(o)
    return Seg(pick(F.least(s.x1, s.x2), mx, s.x1), pick(my, F.least(s.y1, s.y2), s.y1), pick(F.greatest(s.x1, s.x2), mx, s.x2), pick(my, F.greatest(s.y1, s.y2), s.y2))


def point_to_segment(px: Column, py: Column, s: Seg) -> Column:
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    q = dx * dx + dy * dy
    t = F.when(q > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s.x1) * dx + (py - s.y1) * dy) / q))).otherwise(F.lit(0.0))
    return norm(px - (s.x1 + t * dx), py - (s.y1 + t * dy))


def point_to_line(px: Column, py: Column, s: Seg) -> Column:
    """Distance from the infinite line; from the point, if the segment is one."""
    n = length(s)
    return F.when(n > 0, F.abs((px - s.x1) * (s.y2 - s.y1) - (py - s.y1) * (s.x2 - s.x1)) / n).otherwise(norm(px - s.x1, py - s.y1))


def segment_gap(a: Seg, b: Seg) -> Column:
    """Least distance of an end from the other segment (crossing segments don't count as 0)."""
    return F.least(point_to_segment(a.x1, a.y1, b), point_to_segment(a.x2, a.y2, b), point_to_segment(b.x1, b.y1, a), point_to_segment(b.x2, b.y2, a))


def along_and_across(px: Column, py: Column, s: Seg) -> tuple[Column, Column]:
    """Signed coordinates of a point by the segment's midpoint: along it, and along its normal."""
    ux, uy = direction(s)
    mx, my = center(s)
    return (px - mx) * ux + (py - my) * uy, (py - my) * ux - (px - mx) * uy


@dataclass(frozen=True)
class Affine:
    """X = a*x + c*y + e, Y = b*x + d*y + f, as columns."""

    a: Column
    b: Column
    c: Column
    d: Column
    e: Column
    f: Column

    def point(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.a * x + self.c * y + self.e, self.b * x + self.d * y + self.f

    def segment(self, s: Seg) -> Seg:
        return Seg(*self.point(s.x1, s.y1), *self.point(s.x2, s.y2))

    def columns(self) -> list[Column]:
        return [getattr(self, k).alias(k) for k in "abcdef"]


def _turn(rot: Column) -> tuple[Column, Column]:
    """Cosine and sine of quarter turns, exactly."""
    r = F.pmod(rot, F.lit(360))
    cos = F.when(r == 0, 1.0).when(r == 180, -1.0).otherwise(F.lit(0.0))
    sin = F.when(r == 90, 1.0).when(r == 270, -1.0).otherwise(F.lit(0.0))
    return cos, sin


def fit_affine(rot: Column, fx: Column, fy: Column, sx: Column, sy: Column, tx: Column, ty: Column, w: Column, h: Column) -> Affine:
    """Canonical map: a turn about the centre of the page (w, h), then flip and scale, then shift."""
    cos, sin = _turn(rot)
    ox, oy = w / 2 - (cos * w / 2 - sin * h / 2), h / 2 - (sin * w / 2 + cos * h / 2)
    return Affine(fx * sx * cos, fy * sy * sin, -fx * sx * sin, fy * sy * cos, fx * sx * ox + tx, fy * sy * oy + ty)


def match_affine(rot: Column, fx: Column, fy: Column, sx: Column, sy: Column, tx: Column, ty: Column) -> Affine:
    """A turn about the origin, then flip and scale, then shift."""
    zero = F.lit(0.0)
    return fit_affine(rot, fx, fy, sx, sy, tx, ty, zero, zero)


def matrix_affine(rot: Column, fx: Column, fy: Column, sx: Column, sy: Column, tx: Column, ty: Column) -> Affine:
    """Scale first, then a turn about the origin, then flip and shift."""
    cos, sin = _turn(rot)
    return Affine(fx * cos * sx, fy * sin * sx, -fx * sin * sy, fy * cos * sy, tx, ty)


def coarse_point(x: Column, y: Column, rot: Column, flip: Column, x0: Column, y0: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Coarse convention: within the box (x0, y0, w, h) a flip-aware quarter turn in box coordinates: (y, h - x) at 90
    degrees, (w - x, h - y) at 180, (w - y, x) at 270; then the flip, then the box's origin again."""
    u, v = x - x0, y - y0
    r = F.pmod(rot, F.lit(360))
    p = F.when(r == 90, v).when(r == 180, w - u).when(r == 270, w - v).otherwise(u)
    q = F.when(r == 90, h - u).when(r == 180, h - v).when(r == 270, u).otherwise(v)
    return F.when(flip == "x", w - p).otherwise(p) + x0, F.when(flip == "y", h - q).otherwise(q) + y0


def coarse_vector(u: Column, v: Column, rot: Column, flip: Column) -> tuple[Column, Column]:
    """What the coarse convention makes of the difference of two points."""
    r = F.pmod(rot, F.lit(360))
    p = F.when(r == 90, v).when(r == 180, -u).when(r == 270, -v).otherwise(u)
    q = F.when(r == 90, -u).when(r == 180, -v).when(r == 270, u).otherwise(v)
    return F.when(flip == "x", -p).otherwise(p), F.when(flip == "y", -q).otherwise(q)


def affine_of_points(p0: tuple[Column, Column], px: tuple[Column, Column], py: tuple[Column, Column]) -> Affine:
    """The map that sends (0, 0), (1, 0) and (0, 1) to the three points."""
    return Affine(px[0] - p0[0], px[1] - p0[1], py[0] - p0[0], py[1] - p0[1], p0[0], p0[1])


def percent_gap(a: Column, b: Column) -> Column:
    """|b - a| / |a| in percent; null for a zero or anything that isn't finite."""
    ok = ~(F.isnan(a) | F.isnan(b)) & (F.abs(a) != float("inf")) & (F.abs(b) != float("inf")) & (a != 0)
    return F.when(ok, F.abs(b - a) / F.abs(a) * 100)


def nearly(a: Column, b: Column, rel: float = 0.05) -> Column:
    return F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b))


def flip_name(fx: Column, fy: Column) -> Column:
    return F.when((fx < 0) & (fy < 0), "XY").when(fx < 0, "X").when(fy < 0, "Y").otherwise("none")


def fixed(value: Column, digits: int, missing: str = "") -> Column:
    """The number with so many digits; ``missing`` for null, NaN and infinities."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(ok, F.format_string(f"%.{digits}f", value)).otherwise(F.lit(missing))
