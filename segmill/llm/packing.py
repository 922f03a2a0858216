"""Packing of documents into fixed-length token sequences, shortest pack first over the length histogram.

Every text is tokenized whole and followed by one end id. A document longer than a sequence is cut into full sequences
and a rest. The histogram of piece lengths (as many bins as a sequence has tokens, whatever the input's size) goes to the
driver, where lengths are placed longest first, each into the open pack that is shortest, as counts of packing patterns
and not as pieces. Patterns are joined back to pieces by the rank of a piece among those of its length.

Defined results: null and empty texts are the end id alone; the string of a special token within a text is that token's id; repeated rows are documents of their own, so their pieces
appear once for each row; an empty table has no pieces; very long texts are cut, never truncated; other columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow, materialize, slices

#: Pattern by which byte-level vocabularies cut a text before merging; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a code point above Latin are encoded by the ``tokenizers`` library.
LATIN = 0x250
_OTHER = re.compile(f"[^\\x00-{chr(LATIN - 1)}]")


def _byte_of() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow
    from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merged(word: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """The word's parts after all merges, the lowest rank first, of equal ones the leftmost."""
    while len(word) > 1:
        r, i = min((rank.get(p, len(rank)), i) for i, p in enumerate(zip(word, word[1:], strict=False)))
        if r == len(rank):
            break
        word[i : i + 2] = [word[i] + word[i + 1]]
    return word


class Encoder:
    """Ids of texts by the vocabulary file at ``path``, as the ``tokenizers`` library gives them without added special
    tokens; a special token's string in a text is that token, as it is for the library.

    A faster library that merges any neighbours whose union is in the vocabulary, lowest id first, gives the same ids if
    ids are in the order of merges and every entry, encoded alone, is itself. For let neighbours x, y be entry t before
    one of them is part of a later merge. No merge crossed the borders of t until then, so t alone would have come to
    x, y by the same merges; as t alone ends as t, its last merge is that of x and y. Both conditions are tested for
    the whole vocabulary, and the cut into words, which depends on each character's class only, for every code point up to
    ``LATIN``. Texts with others, or with a special token's string, or all texts if a test fails, go to ``tokenizers``."""

    def __init__(self, path: str):
        self.own = Tokenizer.from_file(path)
        self.quick = self._quick()

    def _quick(self) -> tiktoken.Encoding | None:
        told = json.loads(self.own.to_str())
        first, model = told.get("pre_tokenizer") or {}, told["model"]
        if model["type"] != "BPE" or first.get("type") != "ByteLevel" or not first.get("use_regex") or first.get("add_prefix_space") or told["normalizer"] or told["post_processor"]:
            return None
        if model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        self.special = [t["content"] for t in told["added_tokens"]]
        byte_of, vocab = _byte_of(), {t: i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [vocab.get(a + b, -1) for a, b in pairs]
        single = sorted(t for t in vocab if len(t) == 1)
        if single != sorted(byte_of) or len(vocab) != len(single) + len(set(ids)) or ids != sorted(set(ids)) or min(ids) <= max(vocab[t] for t in single):
            return None
        raw = {t: bytes(byte_of[c] for c in t) for t in vocab}
        texts, rank = {}, dict(zip(pairs, range(len(pairs)), strict=True))
        for t, r in raw.items():
            try:
                texts[t] = r.decode()
            except UnicodeDecodeError:  # part of a character
                if _merged(list(t), rank) != [t]:
                    return None
        if [e.ids for e in self.own.encode_batch_fast(list(texts.values()), add_special_tokens=False)] != [[vocab[t]] for t in texts]:
            return None
        quick = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={raw[t]: i for t, i in vocab.items()}, special_tokens={})
        for c in map(chr, range(LATIN)):
            probe = f"a{c}a 1{c}1 .{c}. {c} '{c} {c}{c}  {c}\n{c}\t {c}'s{c}"
            if quick.encode_ordinary(probe) != self.own.encode(probe, add_special_tokens=False).ids:
                return None
        return quick

    def __call__(self, text: str) -> np.ndarray:
        if self.quick and not _OTHER.search(text) and not any(s in text for s in self.special):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        return np.array(self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


@cache
def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
    return Encoder(path)


PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document; ``tokenizer`` is the path of a vocabulary file that executors can read."""
    kind = docs.select(docs[id_col]).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                row, start, length, crc, total = [], [], [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    ids = np.append(encode(t) if t else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), size):
                        piece = ids[at : at + size]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(ids))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(docs[id_col].alias("k"), docs[text].alias("text")).transform(arrow, run, PIECES.format(kind=kind))


Pattern = tuple[tuple[int, int], ...]  # lengths with how often each, in order


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Packing patterns and how many packs follow each."""
    open_: list[list[list]] = [[] for _ in range(size + 1)]  # by length of the pack: [pattern, count]
    for length in sorted(histogram, reverse=True):
        left, at = histogram[length], 0
        while left:
            while at <= size - length and not open_[at]:
                at += 1
            if at > size - length:  # no open pack has room: new ones, filled one after the other
                each = size // length
                if left >= each:
                    open_[each * length].append([((length, each),), left // each])
                if left % each:
                    open_[left % each * length].append([((length, left % each),), 1])
                break
            group = open_[at][-1]
            n = min(left, group[1])
            head, last = group[0][:-1], group[0][-1]
            pattern = (*head, (length, last[1] + 1)) if last[0] == length else (*group[0], (length, 1))
            group[1] -= n
            if not group[1]:
                open_[at].pop()
            open_[at + length].append([pattern, n])
            left -= n
    merged: dict[Pattern, int] = {}
    for groups in open_:
        for pattern, n in groups:
            merged[pattern] = merged.get(pattern, 0) + n
    return list(merged.items())


@dataclass
class Slots:
    """For each length, runs of ranks that one pattern takes; sorted by length and first rank."""

    key: np.ndarray  # length * 2**48 + first rank
    each: np.ndarray  # pieces of that length in a pack
    sequence: np.ndarray  # first sequence of the pattern
    offset: np.ndarray  # of the first such piece in a pack

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = (length << 48) + rank
        i = np.searchsorted(self.key, want, "right") - 1
        j = want - self.key[i]
        return self.sequence[i] + j // self.each[i], self.offset[i] + j % self.each[i] * length


def slots(patterns: list[tuple[Pattern, int]]) -> Slots:
    rows, taken, first = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for length, each in pattern:
            rows.append(((length << 48) + taken.get(length, 0), each, first, offset))
            taken[length] = taken.get(length, 0) + n * each
            offset += length * each
        first += n
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Slots(*(a[:, k].copy() for k in range(4)))


def ranked(cut: DataFrame, n: int) -> DataFrame:
    """``cut`` with ``rank`` of each piece among those of its length, from 0. Lengths that many pieces share are counted
    in buckets of a hash, so no task gets all pieces of a length."""
    many = max(1, min(4096, n // 400))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(many)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return cut.join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).drop("bucket", "base")


def pack(docs: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document with ``sequence_id`` and ``offset``."""
    cut = materialize(pieces(docs, tokenizer, size=size, end_id=end_id, id_col=id_col, text=text), "pieces")
    # As many rows as a sequence has tokens, at most.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(histogram, size)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off = shared.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked(cut, sum(histogram.values())).select(*names, "rank").transform(arrow, run, PIECES.format(kind=kind) + ", sequence_id long, offset long")
