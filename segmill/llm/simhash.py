"""SimHash near-duplicates: fingerprints, links between near ones, and the groups that links reach.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints, so fingerprints that differ in ``bits`` bits at most differ in the
counts of at most ``bits`` segments. With the segments dealt into ``blocks`` runs, such a pair agrees on the whole grid
cell of at least ``blocks - bits`` runs: every choice of that many runs gives a cell key, and pairs are looked for within
equal keys only. There the Manhattan distance is the first test and the Hamming distance the exact one.

Links are wanted for what they reach, so within a cell only as many are returned as join its members (a cell of m
fingerprints gives at most m - 1). Cells of more than ``cell`` fingerprints are cut into smaller ones: as such a pair
differs in at most ``bits`` of the segments that a cell leaves free, it agrees on one of ``bits + 1`` groups of them, so
members are keyed again by each group's counts as well, a few copies of each. What can't be cut further (equal counts
nearly everywhere) is compared in parts by several tasks. The groups then follow from rounds of distributed star contraction; nothing of this comes to the driver.

Defined results: a null or wordless text has fingerprint 0 and links like any other; a text of fewer words than a
shingle is one shingle; equal fingerprints are linked; a null id is a row like any other, whose group is the smallest
non-null id reached (null if there is none); repeated ids stay repeated rows, each with its own fingerprint, and the
groups of rows that share an id are joined; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, free, materialize, release, slices, small

SEED = 42
SEGMENTS = 32


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 of every shingle (repeats included) of the text's words, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits that more than half of the hashes have; 0 without words."""
    h = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint as a signed long) of every row; no shuffle."""
    kind = docs.select(docs[id_col]).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    return docs.select(docs[id_col].alias("k"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text")).transform(arrow, run, f"doc_id {kind}, th long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: for each fingerprint (uint64) the bit counts of its segments, as 00, 01 or 11 in the segment's
    place, so that equal counts are equal bits and distances of counts are numbers of differing bits."""
    low = np.uint64(0x5555555555555555)
    next_ = fp >> np.uint64(1)
    return ((fp | next_) & low) | ((fp & next_ & low) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the segments of the differences of two embeddings."""
    return np.bitwise_count(a ^ b)


def masks(blocks: int, bits: int) -> np.ndarray:
    """For each choice of ``blocks - bits`` of the runs, the bits of their segments in a packed embedding."""
    edges = [SEGMENTS * i // blocks for i in range(blocks + 1)]
    runs = [sum(3 << 2 * k for k in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return np.array([sum(c) for c in combinations(runs, blocks - bits)], np.uint64)


def pick_blocks(n: int, bits: int) -> int:
    """The number of runs by which keys and chance meetings together are fewest for ``n`` fingerprints. Results don't
    depend on it. Two random segments have equal counts with chance 3/8."""
    cost = lambda b: comb(b, bits) * (n + 0.2 * n * n / 2 * 0.375 ** (SEGMENTS * (b - bits) / b))
    return min(range(bits + 2, 17), key=cost)


def joined(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within ``bits`` of each other in each run of equal keys (``key`` is sorted). Rows d apart
    are compared in round d; runs whose members are all joined drop out."""
    n = len(key)
    root = np.arange(n)
    left, right = [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    emb = segment_counts(fp)
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, int)
    run = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1 if n else np.zeros(0, int)
    open_ = np.diff(np.append(start, n)) - 1  # joins that each run still lacks
    i = np.flatnonzero(open_[run] > 0)
    d = 1
    while i.size:
        i = i[i + d < n]
        i = i[(run[i] == run[np.minimum(i + d, n - 1)]) & (open_[run[i]] > 0)]
        j = i + d
        if i.size:
            ok = root[i] != root[j]
            a, b = i[ok], j[ok]
            ok = manhattan(emb[a], emb[b]) <= bits
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= bits
            for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    open_[run[x]] -= 1
                    left.append(x)
                    right.append(y)
            while not np.array_equal(up := root[root], root):
                root = up
        d += 1
    return np.array(left, int), np.array(right, int)


def links(fps: DataFrame, n: int, *, bits: int = 3, blocks: int | None = None, cell: int = 8192) -> DataFrame:
    """From the distinct fingerprints ``fps`` (fp, node), links (u, v) between nodes, enough of them that what is within
    ``bits`` bits of each other is joined."""
    every = masks(blocks or pick_blocks(n, bits), bits)
    kind = fps.schema["node"].dataType.simpleString()
    schema = f"key long, mask long, fp long, node {kind}"

    def keyed_by(fp: np.ndarray, mask: np.uint64) -> np.ndarray:
        """The key of the grid cell that the masked counts name."""
        h = (segment_counts(fp.view(np.uint64)) & mask) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int(mask) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for mask in every:
                yield pa.RecordBatch.from_arrays([pa.array(keyed_by(fp, mask)), pa.repeat(pa.scalar(int(mask.view(np.int64)), pa.int64()), len(fp)), batch.column("fp"), batch.column("node")], ["key", "mask", "fp", "node"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each member of a large cell once for each group of the segments that the cell leaves free."""
        for batch in batches:
            own = batch.column("mask").to_numpy().view(np.uint64)
            for mask in np.unique(own):
                some = batch.take(pa.array(np.flatnonzero(own == mask)))
                fp = some.column("fp").to_numpy()
                free = [3 << 2 * k for k in range(SEGMENTS) if not int(mask) >> 2 * k & 3]
                for g in range(bits + 1):
                    finer = mask | np.uint64(sum(free[g :: bits + 1]))
                    yield pa.RecordBatch.from_arrays([pa.array(keyed_by(fp, finer)), pa.repeat(pa.scalar(int(finer.view(np.int64)), pa.int64()), len(fp)), some.column("fp"), some.column("node")], ["key", "mask", "fp", "node"])

    keyed, plain, stuck = fps.transform(arrow, emit, schema), [], []
    while True:
        # Cells above the bound: few rows, as each stands for ``cell`` keyed rows; they are looked up in a join of any kind.
        large = materialize(keyed.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > cell), "large")
        if not (found := large.count()):
            plain.append(keyed)
            break
        plain.append(keyed.join(small(large, found), "key", "left_anti"))
        hot = materialize(keyed.join(small(large, found), "key"), "hot")
        # A mask that leaves no more than ``bits`` segments free can't be cut.
        fine = F.bit_count("mask") <= 2 * (SEGMENTS - bits - 1)
        stuck.append(hot.where(~fine))
        if not hot.where(fine).limit(1).count():
            break
        keyed = materialize(hot.where(fine).select("key", "mask", "fp", "node").transform(arrow, cut, schema), "cut")
    zero = F.lit(0)
    dealt = reduce(DataFrame.unionByName, plain).select("key", zero.alias("p"), zero.alias("q"), "fp", "node")
    for rows in stuck:
        # Each member goes to the tasks of all pairs of parts that hold its own.
        parts = F.ceil(F.col("m") / (cell // 2)).cast("int")
        own, other = F.pmod(F.xxhash64("fp"), parts).cast("int"), F.explode(F.sequence(zero, parts - 1))
        rows = rows.select("key", "fp", "node", own.alias("own"), other.alias("other"))
        dealt = dealt.unionByName(rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "node"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by cell; a cell that a batch cuts is kept for the next batch."""
        rest: pa.Table | None = None

        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            k, p, q = (t.column(c).to_numpy() for c in ("key", "p", "q"))
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
            run = np.cumsum(new)
            one = np.concatenate((new[1:], [True])) & new
            keep = np.flatnonzero(~one)
            if not keep.size:
                return
            fp, node = t.column("fp").to_numpy().view(np.uint64)[keep], t.column("node").take(pa.array(keep)).combine_chunks()
            u, v = joined(run[keep], fp, bits)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(u)), node.take(pa.array(v))], ["u", "v"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            k, p, q = (t.column(c).to_numpy() for c in ("key", "p", "q"))
            last = len(k) - int(np.argmin(((k == k[-1]) & (p == p[-1]) & (q == q[-1]))[::-1])) if len(k) and not ((k == k[-1]) & (p == p[-1]) & (q == q[-1])).all() else 0
            yield from found(t.slice(0, last))
            rest = t.slice(last).combine_chunks()
        if rest is not None:
            yield from found(rest)

    width = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "fp")
    return width.select("key", "p", "q", "fp", "node").transform(arrow, compare, f"u {kind}, v {kind}")


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node and root, the smallest node reached, of every node that a link has. Alternating large-star and small-star
    contraction (Kiveris et al. 2014), each round written to the shared folder, until nothing changes."""
    norm = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, before = materialize(norm(edges), "links"), None
    rows = 2 * e.count()  # contraction never adds links
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = norm(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined_ = large.join(down, "u")
        pairs = joined_.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        last, e = e, materialize(norm(pairs), "links", rows)
        release(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def _grouped(docs: DataFrame, id_col: str, text: str, shingle: int, bits: int) -> DataFrame:
    """doc_id, th, fp, root (the group) and component_id of every row."""
    fps = materialize(fingerprints(docs, id_col=id_col, text=text, shingle=shingle), "fingerprints")
    # One node for each fingerprint. ``low`` is its smallest id; fingerprints of null ids alone have none.
    own = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct", fps.count())
    n = own.count()
    near = links(own.select("fp", F.col("fp").alias("node")), n, bits=bits).select("u", "v")
    # An id with several fingerprints joins them.
    twice = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("v"), F.count("*").alias("c")).where("c > 1 and u <> v").select("doc_id", "u")
    same = fps.join(twice, "doc_id").select("u", F.col("fp").alias("v")).where("u <> v")
    reached = components(near.unionByName(same))
    by_fp = own.join(reached, own.fp == reached.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = by_fp.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(by_fp.join(least, "root").select("fp", "root", "component_id"), "groups", n)
    return fps.join(named, "fp")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return _grouped(docs, id_col, text, shingle, bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row of ``docs`` of each group, that with the smallest id (among equal ids, the smallest hash of the text), with
    all its columns."""
    rows = materialize(_grouped(docs, id_col, text, shingle, bits).select("doc_id", "th", "root"), "members")
    n = rows.count()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    # Written, so that the join below reads it from an exchange and a large group's rows can be split.
    stays = materialize(rows.groupBy("root").agg(F.min(order).alias("s")), "stays", n)
    # Rows that share an id and a text can't be told apart: how often each such pair occurs, and whether it stays.
    each = rows.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    own, same = free(docs, "_id", "_th")
    each = materialize(each.join(stays, "root").select(F.col("doc_id").alias(own), F.col("th").alias(same), F.col("n").alias("_n"), (order == F.col("s")).alias("_stays")), "decided", n)
    release(rows, stays)
    of = lambda side: docs[id_col].eqNullSafe(side[own]) & (F.xxhash64(docs[text]) == side[same])
    gone = each.where("not _stays or _n > 1").select(own, same)
    kept = docs.join(small(gone, gone.count()), of(gone), "left_anti")
    again = each.where("_stays and _n > 1").select(own, same)
    if twice := again.count():
        some = docs.join(small(again, twice), of(again), "left_semi").withColumn(same, F.xxhash64(F.col(text)))
        kept = kept.unionByName(some.dropDuplicates([id_col, same]).drop(same))
    return kept
