"""Language identification: multinomial naive Bayes over hashed character n-grams.

Rows are labelled documents; the model is one log-probability matrix (buckets x languages) that is broadcast, and whole
texts are scored in numpy by summing the matrix rows of their n-grams.

Defined results: a null text or one without a letter is ``und`` with score 0; rows with a null id are predicted like
any other and never trained on; repeated rows are counted (in training) and predicted (in scoring) one by one; with no
training rows at all every text is ``und``; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, slices

#: Positions that are hashed and summed at once.
STEP = 1 << 18
ORDERS = (1, 2, 3)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each between two zeros, with everything but letters as a space; the start
    of each text, with the end; whether it has a letter."""
    parts = ["\0" + (t or "").lower() + "\0" for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    letter = _letters()[codes]
    sep = codes == 0
    sep_true = np.zeros(len(codes), bool)
    sep_true[starts[:-1]] = True
    sep_true[starts[1:] - 1] = True
    codes = np.where(letter, codes, 32).astype(np.uint64)
    codes[sep & sep_true] = 0
    return codes, starts, np.add.reduceat(letter, starts[:-1]) > 0 if len(texts) else np.zeros(0, bool)


def buckets(codes: np.ndarray, lo: int, hi: int, n: int, size: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each of the positions lo..hi; ``size`` if it holds no letter or leaves its
    text."""
    ext = codes[lo : hi + n - 1]
    if len(ext) < hi - lo + n - 1:
        ext = np.concatenate((ext, np.zeros(hi - lo + n - 1 - len(ext), np.uint64)))
    h = np.full(hi - lo, 0x9E3779B97F4A7C15 + n, np.uint64)
    out = np.zeros(hi - lo, bool)
    some = np.zeros(hi - lo, bool)
    for k in range(n):
        c = ext[k : k + hi - lo]
        h = (h ^ c) * np.uint64(0x100000001B3)
        out |= c == 0
        some |= c > 32
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(40)
    b = (h & np.uint64(size - 1)).astype(np.int64)
    b[out | ~some] = size
    return b


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (size + 1, languages) float32; the last row is zero
    size: int


def train(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", size: int = 1 << 15, per_lang: int = 4000, seed: int = 1) -> Model:
    """Count n-grams by language on the executors. ``docs`` are the rows to learn from. ``per_lang`` is the documented
    bound on the fit: about so many documents of each language, drawn by a hash of id and text, are counted, each whole;
    so of a text that many documents share no more than its share is drawn."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((size + 1, 0), np.float32), size)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    sample = rows.where(F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("text", "lang")
    index = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), size + 1), np.int64)
        for batch in batches:
            for part in slices(batch):
                which = np.array([index[x] for x in part.column("lang").to_pylist()])
                codes, starts, _ = codes_of(part.column("text").to_pylist())
                owner = np.repeat(which, np.diff(starts))
                for lo in range(0, len(codes), STEP):
                    hi = min(lo + STEP, len(codes))
                    for n in ORDERS:
                        key = owner[lo:hi] * (size + 1) + buckets(codes, lo, hi, n, size)
                        total += np.bincount(key, minlength=total.size).reshape(total.shape)
        total[:, size] = 0
        i, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[i, b])], ["i", "b", "n"])

    counts = sample.transform(arrow, count, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toArrow()
    n = np.full((size, len(langs)), 0.1)
    n[counts["b"].to_numpy(), counts["i"].to_numpy()] += counts["n"].to_numpy()
    logp = np.vstack((np.log(n / n.sum(axis=0)), np.zeros(len(langs)))).astype(np.float32)
    return Model(langs, logp, size)


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the largest posterior under equal priors, with the log-likelihood divided by
    the square root of the number of n-grams, as neighbouring n-grams aren't independent."""
    if not model.langs or not texts:
        return ["und"] * len(texts), np.zeros(len(texts))
    codes, starts, letter = codes_of(texts)
    ll = np.zeros((len(texts), len(model.langs)))
    used = np.zeros(len(texts))
    for lo in range(0, len(codes), STEP):
        hi = min(lo + STEP, len(codes))
        first = np.searchsorted(starts, lo, "right") - 1
        last = np.searchsorted(starts, hi - 1, "right") - 1
        cuts = np.maximum(starts[first : last + 1] - lo, 0)
        for n in ORDERS:
            b = buckets(codes, lo, hi, n, model.size)
            ll[first : last + 1] += np.add.reduceat(model.logp[b], cuts, axis=0)
            used[first : last + 1] += np.add.reduceat((b < model.size).astype(np.int64), cuts)
    z = ll / np.sqrt(np.maximum(used, 1))[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    best = z.argmax(axis=1)
    return [model.langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)], np.where(letter, z[np.arange(len(z)), best], 0.0)


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``lang_pred`` and ``score``, a row for each row of ``docs``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.size))
    cols = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for part in slices(batch):
                lang, score = score_texts(part.column("text").to_pylist(), m)
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}") for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.select(docs[c]).schema[0].dataType.simpleString()}" for c in keep)
    return cols.transform(arrow, run, f"{kinds}, lang_pred string, score double")
