"""Schemas of the tables that operators take and return; every table is keyed by ``doc_id``."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_L, _D, _S, _I = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()

SEGMENTS = _struct(doc_id=_L, side=_S, seg_id=_L, x1=_D, y1=_D, x2=_D, y2=_D)
PAGES = _struct(doc_id=_L, side=_S, w=_D, h=_D)
TEXTS = _struct(doc_id=_L, txt_id=_L, text=_S, cx=_D, cy=_D, w=_D, h=_D)
PIXELS = _struct(doc_id=_L, row=_L, col=_L, val=_D)
#: One affine map: X = a*x + c*y + e, Y = b*x + d*y + f.
AFFINE = _struct(doc_id=_L, direction=_S, a=_D, b=_D, c=_D, d=_D, e=_D, f=_D)
MODEL = _struct(doc_id=_L, rot_deg=_I, fx=_I, fy=_I, sx=_D, sy=_D, tx=_D, ty=_D, score=_D, rmse=_D, p95=_D, median=_D)
END = _struct(x1=_D, y1=_D, x2=_D, y2=_D)
MATCH = _struct(doc_id=_L, id=_I, axis=_S, pdf_seg=END, svg_seg=END, cost=_D, confidence=_D, pdf_len=_D, svg_len=_D, rel_error=_D, pass01=_I)
