"""Shared pieces of the text operators: the word pattern, folds, batches and durable intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.durable import materialize, release

__all__ = ["BATCH_ROWS", "BROADCAST_BYTES", "GAP", "WORD", "arrow", "few_texts", "fold", "free", "held_out", "materialize", "release", "slices", "small"]

#: Separators and words of every word count (Java and Python patterns alike).
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a batch that goes to a Python worker: documents can be long, and a worker holds a batch at a time.
BATCH_ROWS = 1000


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows. For ``DataFrame.transform``. Spark reads the bound from
    the session when the result is run, so the session keeps it; a smaller bound that it has stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


#: Rows of a batch of Parquet columns, of which each task holds the texts in one array.
READ_ROWS = 256


def few_texts(df: DataFrame) -> DataFrame:
    """``df``, read in batches of at most ``READ_ROWS`` rows. Spark reads the bound from the session when the result is run, so
    the session keeps it; a smaller bound that it has stays."""
    conf, key = df.sparkSession.conf, "spark.sql.parquet.columnarReaderBatchSize"
    if not 0 < int(conf.get(key)) <= READ_ROWS:
        conf.set(key, str(READ_ROWS))
    return df


def fold(id_col: str | Column) -> Column:
    """crc32 of the id's text modulo 4; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % 4


def held_out(id_col: str | Column) -> Column:
    return F.coalesce(fold(id_col) == 2, F.lit(False))


def free(df: DataFrame, *wished: str) -> list[str]:
    """The wished names, each with as many underscores behind it as make it differ from every column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wished:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of a join's small side up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def small(side: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``side``, which has ``rows`` rows of about ``row_bytes`` bytes in memory, to be broadcast if it is small."""
    return F.broadcast(side) if rows * row_bytes <= BROADCAST_BYTES else side


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``limit`` bytes together, so that a worker's memory follows
    ``limit`` and the longest single text, not the batch's row count."""
    sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)
