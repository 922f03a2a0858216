"""Weighted histograms of segment centres and their cross-correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial


def _bin(c: Column, lo: Column, hi: Column, bins: int) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - lo) / F.greatest(hi - lo, F.lit(1e-6))))
    return F.least(F.floor(t * bins), F.lit(bins - 1)).cast("int")


def projection(feat: DataFrame, box: DataFrame, bins: int = 64) -> DataFrame:
    """Length-weighted profiles: horizontals by x (profile X) and verticals by y (profile Y). ``box`` has doc_id, side and
    min_x, max_x, min_y, max_y. Rows: doc_id, side, profile, bin, w; empty bins have no row."""
    f = feat.where("axis is not null").join(box.select("doc_id", "side", "min_x", "max_x", "min_y", "max_y"), ["doc_id", "side"])
    h = F.col("axis") == "H"
    b = F.when(h, _bin(F.col("cx"), F.col("min_x"), F.col("max_x"), bins)).otherwise(_bin(F.col("cy"), F.col("min_y"), F.col("max_y"), bins))
    return f.select("doc_id", "side", F.when(h, "X").otherwise("Y").alias("profile"), b.alias("bin"), "len").groupBy("doc_id", "side", "profile", "bin").agg(F.sum("len").alias("w"))


def counts(feat: DataFrame, pages: DataFrame, bin_size: float, least: int = 16) -> DataFrame:
    """Counts of centres over the page, by axis of the page (X, Y): max(least, ceil(extent / bin_size)) bins, of which the
    last holds its right edge; centres off the page don't count."""
    f = feat.join(pages, ["doc_id", "side"])
    both = F.explode(F.array(F.struct(F.lit("X").alias("profile"), F.col("cx").alias("c"), F.col("w").alias("extent")), F.struct(F.lit("Y").alias("profile"), F.col("cy").alias("c"), F.col("h").alias("extent")))).alias("p")
    f = f.select("doc_id", "side", both).select("doc_id", "side", "p.*").where("c >= 0 and c <= extent")
    bins = F.greatest(F.lit(least), F.ceil(F.col("extent") / bin_size))
    f = f.withColumn("bins", bins.cast("int")).withColumn("bin", F.least(F.floor(F.col("c") / F.col("extent") * F.col("bins")), F.col("bins") - 1).cast("int"))
    return f.groupBy("doc_id", "side", "profile", "bins", "bin").agg(F.count("*").alias("n"))


def heatmap(feat: DataFrame, box: DataFrame, size: int = 32) -> DataFrame:
    """Counts of centres over a square raster, as shares of the fullest cell."""
    f = feat.join(box.select("doc_id", "side", "min_x", "max_x", "min_y", "max_y"), ["doc_id", "side"])
    g = f.select("doc_id", "side", _bin(F.col("cy"), F.col("min_y"), F.col("max_y"), size).alias("iy"), _bin(F.col("cx"), F.col("min_x"), F.col("max_x"), size).alias("ix")).groupBy("doc_id", "side", "iy", "ix").agg(F.count("*").alias("n"))
    top = g.groupBy("doc_id", "side").agg(F.max("n").alias("_top"))
    return g.join(top, ["doc_id", "side"]).select("doc_id", "side", "iy", "ix", (F.col("n") / F.col("_top")).alias("v"))


def xcorr(prof: DataFrame, bins: int, *, circular: int | None = None, keys: tuple[str, ...] = ("doc_id", "profile")) -> DataFrame:
    """Cross-correlation of the two sides' sparse profiles by a join of bins: keys, shift (in bins, svg to pdf) and c, the
    sum of products over the product of the norms. Circular over ``circular`` bins (the next power of two by default)."""
    n = circular or 1 << (2 * bins - 1).bit_length()
    a = prof.where("side = 'pdf'").select(*keys, F.col("bin").alias("i"), F.col("w").alias("a"))
    b = prof.where("side = 'svg'").select(*keys, F.col("bin").alias("j"), F.col("w").alias("b"))
    na = a.groupBy(*keys).agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"))
    nb = b.groupBy(*keys).agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    half = F.pmod(F.col("i") - F.col("j"), F.lit(n))
    c = a.join(b.hint(spatial.UNSENT), list(keys)).groupBy(*keys, F.when(half > n // 2, half - n).otherwise(half).alias("shift")).agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    return c.join(na.hint(spatial.UNSENT), list(keys)).join(nb.hint(spatial.UNSENT), list(keys)).select(*keys, "shift", (F.col("s") / (F.col("na") * F.col("nb"))).alias("c"))


def peak(corr: DataFrame, *keys: str) -> DataFrame:
    """The shift of the largest correlation; of equal ones the first in circular order (from 0 up, then from below)."""
    order = F.when(F.col("shift") >= 0, F.col("shift")).otherwise(F.col("shift") + (1 << 30))
    return corr.groupBy(*keys).agg(F.max(F.struct("c", (-order).alias("o"), "shift")).alias("m")).select(*keys, F.col("m.shift").alias("shift"), F.col("m.c").alias("peak"))


def fft_xcorr(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """Peak of the circular cross-correlation over the next power of two: shift and normalised height."""
    n = 1 << max(1, len(a) + len(b) - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n)
    k = int(c.argmax())
    scale = float(np.linalg.norm(a) * np.linalg.norm(b))
    return (k if k <= n // 2 else k - n), float(c[k]) / scale if scale > 0 else 0.0


def xcorr_fft(prof: DataFrame, bins: int) -> DataFrame:
    """The peaks of ``xcorr`` by Fourier transforms, for profiles of thousands of bins: doc_id, profile, shift, peak."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {}
        for s in ("pdf", "svg"):
            v = np.zeros(bins)
            own = pdf[pdf.side == s]
            np.add.at(v, own.bin.to_numpy(int), own.w.to_numpy(float))
            side[s] = v
        shift, top = fft_xcorr(side["pdf"], side["svg"])
        return pd.DataFrame({"doc_id": [pdf.doc_id.iloc[0]], "profile": [pdf.profile.iloc[0]], "shift": [shift], "peak": [top]})

    return prof.groupBy("doc_id", "profile").applyInPandas(run, "doc_id long, profile string, shift int, peak double")


def low_pass(v: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian weights on the spectrum, of width ``sigma`` in units of one over the number of bins; any dimension."""
    f = np.fft.fftn(v)
    r2 = sum(np.meshgrid(*[(np.fft.fftfreq(n) * n / max(sigma, 1e-9)) ** 2 for n in v.shape], indexing="ij"))
    return np.real(np.fft.ifftn(f * np.exp(-0.5 * r2)))


def oriented(prof: DataFrame, bins: int, rot: int, flip: str) -> DataFrame:
    """The svg side's profiles under a quarter turn (X and Y change places at 90 and 270) and a flip (bins reversed)."""
    p = F.col("profile")
    turned = F.when(p == "X", "Y").otherwise("X") if rot % 180 == 90 else p
    mirrored = F.lit({"x": "X", "y": "Y"}.get(flip, ""))
    svg = prof.where("side = 'svg'").withColumn("profile", turned)
    svg = svg.withColumn("bin", F.when(F.col("profile") == mirrored, bins - 1 - F.col("bin")).otherwise(F.col("bin")))
    return prof.where("side <> 'svg'").unionByName(svg)
