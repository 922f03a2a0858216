"""Mixing of sources to target weights, in blocks of words.

The documents of each source, in a pseudorandom order, form one stream of words that is cut into blocks of a fixed
length. The output is dealt into shards of a fixed number of slots; every slot draws its source with the sources' shares
of the targets, so that a shard's counts are multinomial. Slots are numbered through within their source, and a
pseudorandom permutation of the source's block numbers says which block fills a slot: the first pass takes every block
once, the next starts over with another permutation.

Multinomial counts stray from their targets by the square root of a source's slots. Draws that a source gets beyond its
target are drawn anew for those that lack some, so that in the end every source has the slots of its target; this touches
the square root of the slots, the others stay as drawn.

A draw is a point on a line on which each source has an interval; points and intervals meet by equal cells of the line, so
any number of sources is drawn from without a list of them in one row. Numbers within a source are summed over groups of
shards first.

The permutation is swap-or-not (Hoang, Morris, Rogaway 2012): it works on any number of blocks with plain column
arithmetic. Everything here is DataFrame operations.

Defined results: a null text has size 0; documents of size 0 take 0; a null source is a source, the last one; repeated
rows are documents of their own; with no words at all every target and take is 0; an empty table gives no rows; other
columns are ignored, or kept by ``mixed`` under any names. The table of sources (a name and a few numbers each) is
sorted in one task, as their order sets their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, few_texts, free, materialize, release, small

#: Rounds of the permutation.
ROUNDS = 12


def word_count(text: Column) -> Column:
    """Words of ``text``; a null has none."""
    parts = F.split(text, GAP)
    # Only the first and the last part can be empty.
    edge = lambda i: F.when(F.try_element_at(parts, F.lit(i)) == "", 1).otherwise(0)
    return F.when(text.isNull(), F.lit(0)).otherwise(F.when(F.size(parts) == 1, 1 - edge(1)).otherwise(F.size(parts) - edge(1) - edge(-1))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``s`` (its place by code point, null last) and ``target``.

    Targets are ``share`` of all words by weight, with none above ``most`` times its source. Raising one common level
    until the sum is reached gives the same targets as dealing out the excess again and again: in the order of
    size over weight, sources are full up to a point and all later ones have the same level."""
    by_name, all_ = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("double")
    t = sizes.withColumn("s", (F.row_number().over(by_name) - 1).cast("int")).withColumn("w", w).withColumn("full", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("full") / F.col("w"), "s")
    t = t.withColumn("before", F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("weights", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.sum("source_size").over(all_) * float(share) - F.col("before")) / F.col("weights"))
    t = t.withColumn("open", F.col("level") * F.col("w") <= F.col("full"))
    # The level of the first source that isn't filled; none is left over if all are full.
    t = t.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("full") / F.col("w"), "s", "level"))).over(all_)["level"])
    return t.select("source", "source_size", "s", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("full")), F.col("full")).alias("target"))


def permuted(df: DataFrame, index: str, n: str, keys: list[str], seed: int) -> DataFrame:
    """``df`` with ``index``, a number from 0 to ``n`` - 1, replaced by its image under the permutation of the keys.
    Write the result before filtering or joining on ``index``: a predicate on it would be pushed through the rounds, each
    of which names the round before three times."""
    names = [c for c in df.columns if c != index]
    for r in range(ROUNDS):
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), F.lit(r), *keys), F.col(n)) - F.col(index), F.col(n))
        df = df.select(*names, index, partner.alias("_partner"))
        swap = F.xxhash64(F.lit(seed + 1), F.lit(r), *keys, F.greatest(index, "_partner")).bitwiseAND(1) == 1
        df = df.select(*names, F.when(swap, F.col("_partner")).otherwise(F.col(index)).alias(index))
    return df


#: Shards that are summed together before numbers within a source run over all of them.
GROUP = 1024


def intervals(targets: DataFrame, block: int) -> DataFrame:
    """Each source with words as an interval low..high of the line from 0 to 1, as long as its share of the slots: s,
    blocks, slots (of all sources), own (slots of its target), low, high."""
    t = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    t = t.withColumn("want", F.col("target") / F.col("source_size") * F.col("blocks"))
    upto = F.sum("want").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("upto", upto).withColumn("all", F.max("upto").over(Window.partitionBy()))
    t = t.withColumn("before", F.coalesce(F.lag("upto").over(Window.orderBy("s")), F.lit(0.0)))
    own = (F.round("upto") - F.round("before")).cast("long")
    return t.select("s", "blocks", F.round("all").cast("long").alias("slots"), own.alias("own"), (F.col("before") / F.col("all")).alias("low"), F.when(F.col("upto") == F.col("all"), F.lit(1.0)).otherwise(F.col("upto") / F.col("all")).alias("high"))


def drawn(spans: DataFrame, sources: int, slots: int, shard_slots: int, seed: int, tasks: int) -> DataFrame:
    """Multinomial counts: s, blocks, shard, n (slots of the source in the shard)."""
    cells = max(1, min(1 << 20, 4 * sources))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    at = spans.where("high > low").select("s", "blocks", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    points = spans.sparkSession.range(0, slots, 1, tasks).select(F.floor(F.col("id") / shard_slots).alias("shard"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / float(1 << 52)).alias("u"))
    met = points.withColumn("cell", cell(F.col("u"))).join(small(at, 5 * sources), "cell").where("low <= u and u < high")
    return met.groupBy("shard", "s", "blocks").agg(F.count("*").alias("n"))


def numbered(counts: DataFrame) -> DataFrame:
    """``counts`` with ``first``, the number within its source of a shard's first slot."""
    c = counts.withColumn("group", F.floor(F.col("shard") / GROUP))
    before = Window.partitionBy("s").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = c.groupBy("s", "group").agg(F.sum("n").alias("sum")).select("s", "group", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return c.join(base, ["s", "group"]).select("shard", "s", "blocks", "n", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first"))


def settled(counts: DataFrame, spans: DataFrame) -> DataFrame:
    """``counts`` (shard, s, n) with the draws beyond each source's target drawn anew for sources that lack some, in order."""
    c = numbered(counts).join(spans.select("s", "own"), "s")
    c = c.withColumn("over", F.least(F.col("n"), F.greatest(F.lit(0), F.col("first") + F.col("n") - F.col("own"))))
    total = counts.groupBy("s").agg(F.sum("n").alias("n"))
    lack = spans.join(total, "s", "left").select("s", "blocks", (F.col("own") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    # Both have about as many rows as the square root of all slots.
    each = lambda df, order: df.withColumn("upto", F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)))
    spare = each(c.where("over > 0").select("shard", F.col("s").alias("was"), F.col("over").alias("n")), ("shard", "was"))
    again = spare.select("k", "shard").join(each(lack, ("s",)).select("k", "s", "blocks"), "k").groupBy("shard", "s", "blocks").agg(F.count("*").alias("n"))
    kept = c.where("n > over").select("shard", "s", "blocks", (F.col("n") - F.col("over")).alias("n"))
    return kept.unionByName(again).groupBy("shard", "s", "blocks").agg(F.sum("n").alias("n"))


def plan(counts: DataFrame, *, most: int, seed: int, tasks: int) -> DataFrame:
    """The output: a row for each slot with its shard, source (s), pass and block; no block is taken in more than ``most``
    passes."""
    d = numbered(counts).withColumn("n", F.least(F.col("n"), F.greatest(F.lit(0), F.col("blocks") * most - F.col("first"))))
    # Dealt out again, as a few rows here become very many.
    slot = d.where("n > 0").repartition(tasks, "shard", "s").select("shard", "s", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    slot = slot.select("shard", "s", "blocks", F.floor(F.col("slot") / F.col("blocks")).alias("pass"), (F.col("slot") % F.col("blocks")).alias("block"))
    return permuted(slot, "block", "blocks", ["s", "pass"], seed + 7)


def located(sized: DataFrame, targets: DataFrame, n: int, seed: int) -> DataFrame:
    """``sized`` (doc_id, source, size, th) with s, source_size, target and ``at``, its first word in the stream of its source.
    The order is by a hash; sums run over buckets of the hash first, so no task gets a whole source."""
    many = max(1, min(1 << 15, n // 200))
    keyed = sized.withColumn("key", F.xxhash64("doc_id", "size", "th", F.lit(seed))).withColumn("bucket", F.pmod(F.col("key"), F.lit(many)).cast("int"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("sum")).select("source", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    sums = sums.join(targets, sums.source.eqNullSafe(targets.source)).select(sums.source.alias("_source"), sums.bucket.alias("_bucket"), "base", "s", "source_size", "target")
    joined = keyed.join(sums, (F.col("bucket") == F.col("_bucket")) & F.col("source").eqNullSafe(F.col("_source")))
    inside = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select("doc_id", "source", "size", "th", "s", "source_size", "target", (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("at"))


def cut_pieces(placed: DataFrame, block: int) -> DataFrame:
    """The part of each block that each document holds: doc_id, th, s, at, size, block, low, high (words of the document)."""
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    p = placed.where("size > 0").select("doc_id", "th", "s", "source_size", "target", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    return p.withColumn("low", low).withColumn("high", F.least((F.col("block") + 1) * block - F.col("at"), F.col("size")))


class Mix:
    """The tables of one mix over ``docs``; ``sizes`` and what is derived from it hold no texts."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = 64, shard_slots: int = 8192, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 11):
        self.block, self.most = block, most
        self.docs, self.id_col, self.text = few_texts(docs), id_col, text
        self.rows = docs.count()
        sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("th"))
        self.sizes = materialize(sized, "sizes", self.rows)
        by_source = self.sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.targets = materialize(source_targets(by_source, weights, share, most), "targets", by_source.count())
        self.placed = located(self.sizes, self.targets, self.rows, seed)
        spans = intervals(self.targets, block)
        sources, slots = spans.agg(F.count("*"), F.coalesce(F.max("slots"), F.lit(0))).first()
        tasks = max(1, min(1 << 15, slots // (1 << 18)))
        most_counts = sources * (slots // shard_slots + 1)
        draws = materialize(drawn(spans, sources, slots, shard_slots, seed, tasks), "draws", most_counts)
        counts = materialize(settled(draws, spans), "counts", most_counts)
        # Written, as a filter on its block number would be pushed through the rounds of the permutation and repeat each
        # of them in the next.
        self.slots = materialize(plan(counts, most=most, seed=seed, tasks=tasks), "slots", slots)
        release(draws, counts)

    def taken(self) -> DataFrame:
        """For each document: doc_id, size, source_size, target, taken."""
        times = self.slots.groupBy("s", "block").agg(F.count("*").alias("times"))
        p = cut_pieces(self.placed, self.block).join(times, ["s", "block"], "left")
        words = (F.col("high") - F.col("low")) * F.coalesce("times", F.lit(0))
        some = p.groupBy("doc_id", "s", "at", "size").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(words).alias("taken"))
        none = self.placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        names = ["doc_id", "size", "source_size", "target", "taken"]
        return some.select(*names).unionByName(none.select(*names))

    def mixed(self) -> DataFrame:
        """The mix itself, as rows of ``docs`` with all their columns: one row for each document and pass that takes any
        of its words, whose text is what is taken, whole texts as they are. Documents that no slot takes are not in it."""
        pieces = cut_pieces(self.placed, self.block).join(self.slots.select("s", "block", "pass"), ["s", "block"])
        span = F.array_sort(F.collect_list(F.struct("low", "high"))).alias("_spans")
        taken = pieces.groupBy("doc_id", "th", "s", "at", "size", "pass").agg(span, F.sum(F.col("high") - F.col("low")).alias("n"))
        whole = F.col("n") == F.col("size")
        docs = self.docs
        own, same, is_whole, spans = free(docs, "_id", "_th", "_whole", "_spans")
        taken = materialize(taken.select(F.col("doc_id").alias(own), F.col("th").alias(same), whole.alias(is_whole), F.when(~whole, F.col("_spans")).alias(spans)), "taken", self.rows * self.most)
        if self.sizes.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            # Rows that share an id and a text have a place each in ``taken``; one of them is joined with all places.
            key = free(docs, "_same")[0]
            docs = docs.withColumn(key, F.xxhash64(F.col(self.text))).dropDuplicates([self.id_col, key]).drop(key)
        # As many rows as documents, so both sides are shuffled at any size that isn't tiny.
        both = docs.join(taken, docs[self.id_col].eqNullSafe(F.col(own)) & (F.xxhash64(docs[self.text]) == F.col(same)))
        words = F.regexp_extract_all(docs[self.text], F.lit(f"{WORD}(?:{GAP})?"), F.lit(0))
        cut = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(spans, lambda x: F.slice(w, (x["low"] + 1).cast("int"), (x["high"] - x["low"]).cast("int")))), "")), F.lit(0))
        text = F.when(F.col(is_whole), docs[self.text]).otherwise(F.rtrim(cut))
        return both.select(*[text.alias(c) if c == self.text else docs[c] for c in docs.columns])
