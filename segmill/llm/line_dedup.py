"""Line deduplication across documents: exact and within one edit, the earliest line stays.

Lines are what newlines separate, without blanks at their ends. A line that isn't empty goes if an earlier line, in the
order of (document id, hash of the text, line number), equals it. A line of at least ``least`` characters also goes if an
earlier line is one insertion, deletion or substitution of a character away; one edit is much of a shorter line.

Near lines meet in a deletion-neighbourhood join. If one edit separates two lines then one becomes the other by deleting
a character, or both become the same by deleting the character at the same place; so each line emits the keyed hash of
itself and of itself without each of its characters, equal keys are joined, and the edit distance of a joined pair is
verified on the texts.

Variants that can't meet another line's aren't emitted, which two exact tests decide. An edit leaves the first or the
last half of a line untouched: lines whose first and last parts (of a length set by the line's length class) no other
line has can't have a partner. For those left, an edit falls into one of ``HOLES`` stretches and leaves all before and
behind it: deletions are emitted for the stretches around which another line is the same.

Lines are known by 128 bits of hash; texts are moved for candidates only. A key that many lines share isn't expanded
into pairs: its lines are sorted, and of those that lost the character at one place only the earliest is remembered, so a
task holds one line for each place at most.

Defined results: a null text stays null; an empty one stays empty; rows are told apart by id and text, so rows that share an
id but not the text keep their own lines, while equal rows are one occurrence and are treated alike; rows with a null id
come last in the order; the columns of ``docs`` are all kept, under any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, free, materialize, release, slices, small

HOLES = 8

BLANK = " \t\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5, which other engines can compute, too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def occurrences(docs: DataFrame) -> DataFrame:
    """A row for each line that isn't empty: its place, its hashes and its text ``t``."""
    # The key and the lines of a text are computed once, below the generator.
    lines = docs.where("text is not null").select("doc_id", text_key(F.col("text")).alias("tie"), F.split("text", "\n").alias("lines"))
    lines = lines.select("doc_id", "tie", F.posexplode("lines").alias("line", "raw")).select("doc_id", "tie", "line", bare(F.col("raw")).alias("t")).where("t <> ''")
    return lines.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "line").alias("place"), F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), "t")


def part_keys(t: Column) -> Column:
    """Hashes of the first and of the last c characters, where c is half of the power of two that the line's length
    reaches; a line whose length is such a power has those of the class below too, as its partner may be one shorter."""
    n = F.length(t)
    top = F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 1)

    def of(size: Column) -> list[Column]:
        c = F.shiftright(size, 1)
        return [F.xxhash64(F.lit(0), c, F.substring(t, F.lit(1), c)), F.xxhash64(F.lit(1), c, F.substring(t, n - c + 1, c))]

    return F.when(n == top, F.array(*of(top), *of(F.shiftright(top, 1)))).otherwise(F.array(*of(top)))


def hole_keys(text: str) -> list[tuple[int, int, int]]:
    """(key, first, end): what stands around each stretch first..end of the line, for a partner as long or shorter by
    one (in both of which the stretches are the shorter length's), and where an edit may fall."""
    n, out = len(text), []
    for m in (n, n - 1):
        for i in range(HOLES):
            a, b = m * i // HOLES, m * (i + 1) // HOLES
            rest = text[:a] + "\0" + text[n - (m - b) :]
            out.append((xxhash.xxh64_intdigest(f"{m} {i} {rest}".encode("utf-8", "surrogatepass")) - (1 << 63), a, min(n, b + (n - m))))
    return out


def deletion_keys(text: str) -> np.ndarray:
    """Hashes (uint64) of the line and of the line without each of its characters, the former first. A polynomial hash
    gives each from those of what is before and after the character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c)
    with np.errstate(over="ignore"):
        power = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, BASE, np.uint64))))
        mixed = c * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        before = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(mixed * power[:n])))  # characters at their places
        after = before[-1] - before[1:]  # those behind the deleted one, one place too far to the right
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        whole = before[-1:]
        out = np.concatenate((whole + power[n : n + 1], before[:-1] + after * inverse + power[n - 1 : n]))
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def within_one(a: str, b: str) -> bool:
    """Whether the edit distance is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    lo, hi = 0, len(a)
    while lo < hi:  # length of the common start
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    if len(a) == len(b):
        return lo == len(a) or a[lo + 1 :] == b[lo + 1 :]
    return a[lo:] == b[lo + 1 :]


def near(first: DataFrame, lines: DataFrame, distinct: int, least: int) -> DataFrame:
    """h1, h2 of the ``distinct`` lines (``first``: h1, h2, place of the first occurrence, keys) of at least ``least``
    characters that are within one edit of a different line whose first occurrence is earlier. ``lines`` has the texts."""
    keyed = first.select("h1", "h2", F.explode("keys").alias("key"))
    # A line's keys differ, so a key counted twice has two lines.
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    able = materialize(keyed.join(shared, "key", "left_semi").select("h1", "h2").distinct(), "able", distinct)
    texts = lines.join(small(able, able.count()), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("place").alias("place"), F.min("t").alias("t"))
    texts = materialize(texts, "candidates")

    def holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 18):
                rows = [(i, *k) for i, t in enumerate(part.column("t").to_pylist()) for k in hole_keys(t)]
                i, key, a, b = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column("h1").take(take), part.column("h2").take(take), pa.array(a), pa.array(b)], ["key", "h1", "h2", "a", "b"])

    around = texts.select("t", "h1", "h2").transform(arrow, holes, "key long, h1 long, h2 long, a long, b long")
    met = around.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    spans = around.join(met, "key", "left_semi").groupBy("h1", "h2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the whole line (place -1) and for each place of a character that an edit may touch."""
        for batch in batches:
            for i, (t, spans) in enumerate(zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                at = np.unique(np.concatenate([np.full(1, -1), *(np.arange(s["a"], s["b"]) for s in spans)]))
                k = deletion_keys(t)[at + 1]
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(at.astype(np.int32)), *(pa.repeat(batch.column(c)[i], len(k)) for c in ("h1", "h2"))], ["key", "at", "h1", "h2"])

    emitted = materialize(texts.join(spans, ["h1", "h2"]).select("t", "spans", "h1", "h2").transform(arrow, emit, "key long, at int, h1 long, h2 long"), "variants")
    # Keys that two different lines share; a line's own places can have equal keys.
    twice = emitted.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"), F.max("h2").alias("d")).where("a <> b or c <> d").select("key")
    pairs = emitted.join(twice, "key", "left_semi").join(texts, ["h1", "h2"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and place. Two lines of a key are within one edit if one is the key itself, or if they
        lost the character at the same place; any other near pair of them has such a key elsewhere. So the earliest
        line of each place, and the earliest of all, stand for what is earlier."""
        key, first, by_place = None, None, {}
        for batch in batches:
            gone = []
            for i, (k, at, t) in enumerate(zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), batch.column("t").to_pylist(), strict=True)):
                if k != key:
                    key, first, by_place = k, t, {}
                held = (by_place.get(at), by_place.get(-1)) if at >= 0 else (first,)
                if len(t) >= least and any(e is not None and e != t and within_one(e, t) for e in held):
                    gone.append(i)
                by_place.setdefault(at, t)
            take = pa.array(gone, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("h1").take(take), batch.column("h2").take(take)], ["h1", "h2"])

    ordered = pairs.repartition("key").sortWithinPartitions("key", "place", "h1", "h2", F.desc("at")).select("key", "at", "h1", "h2", "t")
    out = materialize(ordered.transform(arrow, decide, "h1 long, h2 long").distinct(), "near")
    release(able, texts, emitted)
    return out


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least: int = 20) -> DataFrame:
    """doc_id, tie and ``gone``, the numbers (from 0) of the lines that go, for each text that loses any; written."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    lines = occurrences(docs)
    # A line that is one shorter than ``least`` can still be the earlier one of a near pair.
    keys = F.when(F.length("t") >= least - 1, part_keys(F.col("t"))).otherwise(F.array().cast("array<bigint>"))
    seen = materialize(lines.select("place", "h1", "h2", keys.alias("keys")), "lines")
    # Equal lines have equal keys.
    first = materialize(seen.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")), "first", seen.count())
    distinct = first.count()
    near_ = near(first, lines, distinct, least)
    close = near_.withColumn("near", F.lit(True))
    bad = first.join(close, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    # Written, so that both sides of the next join come from their exchanges and a line that is very common can be split.
    bad = materialize(bad, "bad", distinct)
    gone = seen.select("place", "h1", "h2").join(small(bad, bad.count(), 128), ["h1", "h2"]).where("near or place <> first")
    gone = materialize(gone.groupBy("place.doc_id", "place.tie").agg(F.collect_set("place.line").alias("gone")), "gone")
    release(seen, first, near_, bad)
    return gone


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least: int = 20) -> DataFrame:
    """``docs`` with the lines that go taken out of the text, and ``_lines`` and ``_dropped``, how many lines there were
    and how many went (with further underscores if ``docs`` has such columns)."""
    gone_id, gone_tie, gone, own = free(docs, "_gone_id", "_gone_tie", "_gone", "_own")
    n_lines, n_dropped = free(docs, "_lines", "_dropped")
    lost = dropped_lines(docs, id_col=id_col, text=text, least=least).toDF(gone_id, gone_tie, gone)
    # The numbers of a document's lines take far less room than its text.
    size = lost.agg(F.count("*") * 48 + F.coalesce(F.sum(F.size(gone)), F.lit(0)) * 8).first()[0]
    mine = docs.withColumn(own, text_key(F.col(text)))
    both = mine.join(small(lost, int(size), 1), F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_tie)), "left")
    # One pass over the lines and one over those that go; the split text is bound, not split again for each line.
    left = F.transform(F.array(F.split(text, "\n")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)), "\n"))
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.get(left, F.lit(0)))
    count = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("long")
    names = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*names, count.alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped))


#: The same in DuckDB, with every line's deletions: two lines of one length that lose their characters at one place and
#: are equal, or a line that equals another less one character.
ORACLE_SQL = r"""
WITH d AS (
  SELECT *, ('0x' || substr(md5(text), 1, 15))::BIGINT AS tie FROM documents
), raw AS (
  SELECT doc_id, tie, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line
  FROM (SELECT DISTINCT doc_id, tie, text FROM d WHERE text IS NOT NULL)
), occ AS (
  SELECT (doc_id IS NULL, coalesce(doc_id, 0), tie, line) AS place, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t, raw FROM raw
), first AS (
  SELECT t, min(place) AS place FROM occ WHERE t <> '' GROUP BY t
), var AS (
  SELECT t, place, p, left(t, p - 1) AS a, substr(t, p + 1) AS b FROM (SELECT t, place, unnest(range(1, length(t) + 1)) AS p FROM first WHERE length(t) >= 19)
), keyed AS (
  SELECT md5(t) AS t, length(t) AS n, place, p, hash(a || chr(0) || b) AS around, hash(a || b) AS less FROM var
), near AS (
  SELECT t FROM (SELECT t, n, place, min(place) OVER (PARTITION BY p, around) AS low FROM keyed) WHERE low < place AND n >= 20
  UNION
  SELECT CASE WHEN k.place < f.place THEN f.m ELSE k.t END FROM keyed k JOIN (SELECT md5(t) AS m, length(t) AS n, hash(t) AS h, place FROM first) f ON k.less = f.h
  WHERE CASE WHEN k.place < f.place THEN f.n ELSE k.n END >= 20
), kept AS (
  SELECT o.place[2] AS doc_id, o.place[1] AS none, o.place[3] AS tie, count(*) AS n, string_agg(raw, chr(10) ORDER BY o.place[4]) AS text
  FROM occ o LEFT JOIN first f USING (t) LEFT JOIN near x ON x.t = md5(o.t) WHERE o.t = '' OR (o.place = f.place AND x.t IS NULL) GROUP BY ALL
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  (CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END - coalesce(k.n, 0))::BIGINT AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN kept k ON k.none = (d.doc_id IS NULL) AND k.doc_id = coalesce(d.doc_id, 0) AND k.tie = d.tie
"""
