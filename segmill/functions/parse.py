"""Column functions that read numbers, units and labels from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of each length unit of drawings, in pixels at 96 to the inch.
PIXELS = {"px": 1.0, "": 1.0, "pt": 96.0 / 72.0, "pc": 16.0, "in": 96.0, "cm": 96.0 / 2.54, "mm": 96.0 / 25.4, "q": 96.0 / 101.6}
#: Metres of each unit name.
METRES = {
    "m": 1.0, "meter": 1.0, "metre": 1.0, "metres": 1.0, "meters": 1.0,
    "mm": 0.001, "millimeter": 0.001, "millimetre": 0.001, "millimeters": 0.001, "millimetres": 0.001,
    "cm": 0.01, "centimeter": 0.01, "centimetre": 0.01, "centimeters": 0.01, "centimetres": 0.01,
    "dm": 0.1, "decimeter": 0.1, "decimetre": 0.1,
    "inch": 0.0254, "in": 0.0254,
}
#: Fixed pattern of a dimension label: a number of at most five digits with at most three decimals, and m or cm.
LABEL = r"(?i)(?<!\d)(\d{1,5}(?:[.,]\d{1,3})?)\s*(m|cm)?(?!\s*(?:m2|m²|²|mm)\b)"


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def label_value(text: Column) -> Column:
    """Metres that a label names, null if none or not positive."""
    number = F.regexp_replace(F.regexp_extract(text, LABEL, 1), ",", ".")
    value = F.when(number != "", number.cast("double"))
    metres = F.when(F.lower(F.regexp_extract(text, LABEL, 2)) == "cm", value / 100).otherwise(value)
    return F.when(metres > 0, metres)


def label_unit(text: Column) -> Column:
    return F.when(label_value(text).isNotNull(), "m")


def longest_number(text: Column) -> Column:
    """The longest run of digits and points (a comma is a point) that is a number; the earlier of two as long."""
    tokens = F.regexp_extract_all(F.regexp_replace(text, ",", "."), F.lit(r"[0-9.]+"), F.lit(0))
    ranked = F.array_sort(F.transform(tokens, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.try_cast("double").alias("v"))))
    return F.get(F.filter(ranked, lambda t: t["v"].isNotNull()), F.lit(0))["v"]


def loose_unit(text: Column) -> Column:
    """Letters behind the first number."""
    unit = F.regexp_extract(text, r"\d[\d\s.,]*\s*([a-zA-Zµμ]+)", 1)
    return F.when(unit != "", F.lower(unit))


def length_px(text: Column) -> Column:
    """A length with an optional unit, in pixels; percentages are 0, anything else null."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([a-zA-Z]*)$", 1)
    unit = F.lower(F.regexp_extract(t, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([a-zA-Z]*)$", 2))
    return F.when(t.endswith("%"), F.lit(0.0)).when(number != "", number.try_cast("double") * _lookup(PIXELS, unit))


def unit_metres(unit: Column) -> Column:
    """Metres of a unit: a positive number stands for itself, a name is looked up, none or a blank one is a metre, others
    are null."""
    u = F.lower(F.trim(unit))
    number = u.try_cast("double")
    return F.when(unit.isNull() | (u == ""), F.lit(1.0)).when(number.isNotNull(), F.when(number > 0, number)).otherwise(_lookup(METRES, u))


def bare_floats(text: Column) -> Column:
    """All that reads as a number once letters and commas are blanks."""
    parts = F.split(F.trim(F.regexp_replace(text, r"[A-Za-z,]+", " ")), r"\s+")
    return F.filter(F.transform(parts, lambda p: p.try_cast("double")), lambda v: v.isNotNull())


def points(text: Column) -> Column:
    """Coordinates of a points attribute as structs x, y; a last single number is dropped."""
    v = F.transform(F.filter(F.split(F.trim(text), r"[\s,]+"), lambda p: p != ""), lambda p: p.try_cast("double"))
    n = F.floor(F.size(v) / 2).cast("int")
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(v, 2 * i).alias("x"), F.get(v, 2 * i + 1).alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    return F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def view_box(svg: Column) -> Column:
    """x, y, w, h of the view box in the first 4096 characters; null unless it has four numbers and positive sides."""
    raw = F.regexp_extract(F.substring(svg, 1, 4096), r"""viewBox\s*=\s*["']([^"']*)["']""", 1)
    v = F.transform(F.filter(F.split(F.trim(raw), r"[\s,]+"), lambda p: p != ""), lambda p: p.try_cast("double"))
    ok = (F.size(v) == 4) & (F.size(F.filter(v, lambda x: x.isNull())) == 0)
    made = F.struct(*[F.get(v, F.lit(i)).alias(k) for i, k in enumerate("xywh")])
    return F.when(ok & (F.get(v, F.lit(2)) > 0) & (F.get(v, F.lit(3)) > 0), made)


def has_text(svg: Column) -> Column:
    """Whether a drawing has text elements."""
    return F.regexp_like(svg, F.lit(r"<(?:[A-Za-z0-9_]+:)?(?:text|tspan|flowRoot|flowPara)[\s>/]"))
