"""Compression classifier for text quality.

Two zstandard dictionaries are built from good and from bad labelled texts. A text compresses better with the dictionary
of the texts that it resembles: the difference of its two compressed sizes over their sum is turned into a probability by
logistic regression on labelled rows that built neither dictionary. A text is compressed whole, in chunks, so that a long
one is held against the dictionary all along and not against its own beginning.

Nothing that grows with the input is collected: the sample has about ``per_class`` labelled rows of a class, one text an id;
the driver gets pieces of them, ``samples`` bytes a class, drawn by a hash over all positions of all their texts, and one
number for each row that calibrates.

Defined results: null and empty texts have difference 0, so they all have one score, the calibration's at 0; with no
labelled rows of one of the classes every score is the share of good rows (0.5 without any); with so few that a class
has no row to calibrate or to build with, all rows do both; rows whose id is null or has no label are scored and never
learned from; an id with several label rows is used once for each distinct label, and an id of several documents with the
least of their texts; other columns are ignored; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, materialize, release, slices

#: Level of every compression, in training and scoring.
LEVEL = 9
#: Bytes of a text that are compressed at once.
CHUNK = 1024
#: Bytes of a piece that a dictionary is built from.
PIECE = 512


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float]  # of the difference, and the intercept


class Sizer:
    """Compressors with the two dictionaries; made once for each worker."""

    def __init__(self, model: Model):
        self.model = model
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in (model.good, model.bad)] if model.good and model.bad else []

    def difference(self, text: str | None) -> float:
        """(bad size - good size) / (bad size + good size)."""
        raw = memoryview((text or "").encode("utf-8", "surrogatepass"))
        if not raw or not self.by:
            return 0.0
        a, b = (sum(len(c.compress(raw[i : i + CHUNK])) for i in range(0, len(raw), CHUNK)) for c in self.by)
        return (b - a) / (a + b)

    def score(self, texts: list[str | None]) -> np.ndarray:
        w, c = self.model.weights
        z = np.array([self.difference(t) for t in texts], float) * w + c
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pieces(text: str) -> list[tuple[int, int, bytes]]:
    """The text in pieces: turn (its place in the order of hashes), hash, bytes. Drawing by turn and hash takes one piece of
    every text, from anywhere in it, before a second of any."""
    raw = text.encode("utf-8", "surrogatepass")
    own = xxhash.xxh64_intdigest(raw)
    order = sorted((xxhash.xxh64_intdigest(f"{own} {at}") >> 1, at) for at in range(0, len(raw), PIECE))
    return [(turn, h, raw[at : at + PIECE]) for turn, (h, at) in enumerate(order)]


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary; the pieces themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1500, samples: int = 1 << 22, dict_size: int = 1 << 18, seed: int = 2) -> Model:
    """Fit on a bounded sample: about ``per_class`` labelled rows of each class, drawn by a hash of the id, of which two
    thirds build the dictionaries and one third calibrates."""
    lab = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").distinct()
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, per_class / max(1, n.get(0, 0)))))
    drawn = lab.where(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))
    # ``drawn`` has about two times ``per_class`` short rows at any input size, so that it can be broadcast.
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(drawn), "i")
    part = F.crc32(F.concat(F.lit(f"{seed} "), F.col("i").cast("string")).cast("binary")) % 3
    rows = materialize(rows.groupBy("i", "y").agg(F.min("text").alias("text")).withColumn("calibrates", part == 0), "labelled", 2 * per_class)
    found = {(r["y"], r["calibrates"]): r["n"] for r in rows.groupBy("y", "calibrates").agg(F.count("*").alias("n")).collect()}
    total, good = sum(found.values()), sum(k for (y, _), k in found.items() if y)
    if not 0 < good < total:
        p = min(max(good / total if total else 0.5, 1e-6), 1 - 1e-6)
        return Model(b"", b"", (0.0, float(np.log(p / (1 - p)))))
    if len(found) < 4:
        rows = rows.withColumn("calibrates", F.lit(None))
    builds, calibrates = F.coalesce(~F.col("calibrates"), F.lit(True)), F.coalesce(F.col("calibrates"), F.lit(True))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                for y, t in zip(some.column("y").to_pylist(), some.column("text").to_pylist(), strict=True):
                    turn, h, piece = (list(x) for x in zip(*_pieces(t), strict=True)) if t else ([], [], [])
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(y, pa.int32()), len(turn)), pa.array(turn, pa.int64()), pa.array(h, pa.int64()), pa.array(piece, pa.binary())], ["y", "turn", "h", "piece"])

    pieces = rows.where(builds).select("y", "text").transform(arrow, cut, "y int, turn long, h long, piece binary")
    of = lambda k: [r["piece"] for r in pieces.where(F.col("y") == k).orderBy("turn", "h").limit(max(1, samples // PIECE)).toLocalIterator()]
    model = Model(_dictionary(of(1), dict_size), _dictionary(of(0), dict_size), (0.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([sizer.difference(t) for t in batch.column("text").to_pylist()], pa.float64())], ["y", "x"])

    known = rows.where(calibrates).select("y", "text").transform(arrow, measure, "y int, x double").toArrow().sort_by([("x", "ascending"), ("y", "ascending")])
    release(rows)
    x, y = known["x"].to_numpy(), known["y"].to_numpy().astype(float)
    if model.good and model.bad:
        mean, scale = x.mean(), max(x.std(), 1e-9)
        w, c = _logistic((x - mean)[:, None] / scale, y)
        model.weights = (float(w / scale), float(c - w * mean / scale))
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of each row of ``docs``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(docs[id_col]).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(shared.value)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizer.score(part.column("text").to_pylist()))], [id_col, "score"])

    return docs.select(docs[id_col].alias("k"), docs[text].alias("text")).transform(arrow, run, f"`{id_col}` {kind}, score double")
