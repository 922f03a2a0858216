from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.durable import materialize
from segmill.llm import mixing
from segmill.llm import quality_rules as rules

from .conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_facts(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_facts_are_brute_force(spark, odd):
    rng = random.Random(3)
    made = [(i, "\n".join(prose(rng, rng.randint(0, 9), ("a", "b")) + rng.choice(("", "#", "  é|", "\r")) for _ in range(rng.randint(0, 9))), None, None, None) for i in range(200)]
    block = prose(rng, 12)
    made += [(900 + k, " ".join([block] * k + [prose(rng, 5)] + [block]), None, None, None) for k in range(5)]
    docs = spark.createDataFrame(made, SCHEMA).unionByName(odd)
    for r in rules.facts(docs.select("doc_id", "text", F.col("text").alias("again"))).collect():
        assert tuple(r[n] for n in NAMES) == plain_facts(r.again), r.again


def test_edges(odd, clash, none, labels, none_labels):
    got = rules.judge(odd, labels).collect()
    assert len(got) == odd.count() and all(r.kept is not None and not (r.base_failed and r.kept) for r in got)
    assert sorted(map(str, rules.judge(clash, labels).collect())) == sorted(map(str, got))
    assert rules.judge(none, labels).count() == 0
    assert [r.failed_rule for r in rules.judge(odd, none_labels).collect()] == [None] * odd.count()


def test_cutoffs_keep_the_bound(spark):
    """Bad rows shout; good ones hardly do. The certified cutoff is the lowest of the grid that the exact test allows."""
    known = [("a", True, 40 if i < 4 else 0) for i in range(4000)] + [("b", True, 0)] * 50 + [("a", False, 500)] * 100
    df = spark.createDataFrame(known, "stratum string, good boolean, n_capitals long")
    df = df.withColumns({"word_chars": F.lit(100).cast("long"), "n_symbols": F.lit(0).cast("long"), "n_words": F.lit(50).cast("long"), "n_lines": F.lit(5).cast("long"), "n_dup_lines": F.lit(0).cast("long"), "n_repeat_words": F.lit(0).cast("long")})
    got = {r.stratum: r.asDict() for r in rules.cutoffs(df).collect()}

    def p(n, k, risk=0.005):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(risk) + (n - j) * math.log(1 - risk)) for j in range(k + 1))

    level = 0.05 / (2 * 4)
    want = min((c for c in rules.GRID if p(4000, 4 if c <= 400 else 0) <= level), default=None)
    assert set(got) == {"a"} and got["a"]["cut_capitals"] == want and got["a"]["cut_symbols"] == min(rules.GRID)


def test_every_stratum_rejects_beyond_the_base_rule(spark):
    """Four strata of 1,200 to 2,400 good rows, some of which shout a little; junk of each kind passes the base rule and is
    rejected by the cutoff that the stratum's own rows certify, recomputed here row by row."""
    rng = random.Random(21)
    good, junk = [], []
    size = {"de": 1200, "en": 2400, "es": 1500, "fr": 1300}
    for lang, n in size.items():
        for k in range(n):
            words = [f"{lang}{k}w{i}x" for i in range(24)]
            for i in rng.sample(range(24), rng.choice((0, 0, 0, 1, 2)) if k % 40 else 9):
                words[i] = words[i].upper()
            good.append((len(good), " ".join(words), lang))
        base = [f"{lang}{i}q" for i in range(40)]
        junk += [(-len(junk) - 1, " ".join(base) + " " + "#" * 300, lang), (-len(junk) - 2, " ".join(base).upper(), lang), (-len(junk) - 3, "\n".join(base[:20] + ["same line"] * 30), lang)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    assert all(not got[i].base_failed and not got[i].kept for i, *_ in junk if i % 3 != 0)

    def capitals(t):
        return sum("A" <= c <= "Z" for c in t) * 1000 / sum(map(len, WORD.findall(t)))

    for lang in size:
        own = [capitals(t) for i, t, x in good if x == lang]
        tail = lambda k, n=len(own): sum(math.comb(n, j) * 0.005**j * 0.995 ** (n - j) for j in range(k + 1))  # noqa: E731, B023
        cut = min((c for c in rules.GRID if tail(sum(v >= c for v in own)) <= 0.05 / 16), default=None)
        assert cut is not None
        assert {i for i, t, x in good if x == lang and capitals(t) >= cut} == {i for i, _, x in good if x == lang and not got[i].kept}
        assert got[next(i for i, t, x in junk if x == lang and t.isupper())].failed_rule == "capitals"


def test_all_labels_calibrate(spark):
    """A stratum of 2,000 good rows among 60,000 labelled ones certifies its cutoffs."""
    words = " ".join(f"w{i}x" for i in range(24))
    stratum = F.when(F.col("id") < 2000, "rare").otherwise("most")
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(words).alias("text"), stratum.alias("lang"))
    bad = spark.createDataFrame([(-1, words + " " + "#" * 400, "rare")], docs.schema)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = rules.judge(docs.unionByName(bad), labels)
    assert got.where("doc_id = -1").first().failed_rule == "symbols" and got.where("not kept").count() == 1


def test_targets_are_those_of_repeated_dealing(spark):
    rng = random.Random(8)
    for _ in range(4):
        size = {f"s{i}": rng.choice((10, 200, 3000, 0)) for i in range(9)} | {None: 77}
        got = {r.source: (r.s, r.target) for r in mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
        order = sorted((k for k in size if k is not None)) + [None]
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
        left, full, target = 1.5 * sum(size.values()), set(), {}
        while True:
            rest = left - sum(2 * size[k] for k in full)
            w = sum(weight[k] for k in order if k not in full)
            target = {k: 2 * size[k] if k in full else rest * weight[k] / w for k in order}
            over = {k for k in order if k not in full and target[k] > 2 * size[k]}
            if not over:
                break
            full |= over
        assert [got[k][0] for k in order] == list(range(len(order)))
        assert all(got[k][1] == pytest.approx(target[k]) for k in order)


def test_permutation_is_one(spark):
    n = 1000
    df = spark.range(n).select(F.col("id").alias("block"), F.lit(n).cast("long").alias("blocks"), F.lit(1).alias("s"), F.lit(0).alias("pass"))
    out = [r.block for r in mixing.permuted(df, "block", "blocks", ["s", "pass"], 5).orderBy("block").collect()]
    assert out == list(range(n))
    moved = materialize(mixing.permuted(df.withColumn("was", F.col("block")), "block", "blocks", ["s", "pass"], 5), "moved")
    assert moved.where("was = block").count() < 20


def test_mix(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(1, 400)), None, "hot" if i % 3 == 0 else f"s{i % 7}", 0) for i in range(600)], SCHEMA)
    m = mixing.Mix(docs, block=16)
    got = m.taken().join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == 600 and all(r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
    assert all(abs(k / t - 1) < 0.02 for t, k in by.values())
    assert sorted(map(str, mixing.Mix(docs.repartition(7), block=16).taken().collect())) == sorted(map(str, m.taken().collect()))
    text = m.mixed().groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in text} == {r.doc_id: r.taken for r in got if r.taken}
    plan = m.taken()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_draws_are_multinomial(spark):
    """Counts of 400 shards: each source's mean and variance are those of a multinomial, and so is the covariance."""
    share = {0: 0.5, 1: 0.3, 2: 0.15, 3: 0.05, 4: 0.0}
    ends = [0.0, 0.5, 0.8, 0.95, 1.0, 1.0]
    spans = spark.createDataFrame([(s, 1000, ends[s], ends[s + 1]) for s in share], "s int, blocks long, low double, high double")
    n = {}
    for r in mixing.drawn(spans, 5, 400 * 256, 256, 11, 3).collect():
        n.setdefault(r.shard, [0] * 5)[r.s] += r.n
    a = np.array(list(n.values()), float)
    assert a.shape == (400, 5) and (a.sum(axis=1) == 256).all() and (a[:, 4] == 0).all()
    p = np.array(list(share.values()))
    assert np.allclose(a.mean(axis=0), 256 * p, atol=5 * np.sqrt(256 * 0.25 / 400))
    want = 256 * (np.diag(p) - np.outer(p, p))
    assert np.allclose(np.cov(a.T), want, atol=0.25 * want.max())


def test_settled_counts_are_the_targets(spark):
    rng = random.Random(6)
    own = {0: 900, 1: 300, 2: 60, 3: 4, 4: 36}
    drawn = [0] * 5
    rows = []
    for shard in range(13):
        for s in rng.choices(range(4), (900, 310, 50, 1), k=100):
            rows.append((shard, s))
            drawn[s] += 1
    counts = spark.createDataFrame(rows, "shard long, s int").groupBy("shard", "s").count().selectExpr("shard", "s", "100L as blocks", "count as n")
    spans = spark.createDataFrame([(s, 100, n) for s, n in own.items()], "s int, blocks long, own long")
    got = [(r.shard, r.s, r.n) for r in mixing.settled(counts, spans).collect()]
    assert {s: sum(n for _, t, n in got if t == s) for s in own} == own
    assert {k: sum(n for i, _, n in got if i == k) for k in range(13)} == dict.fromkeys(range(13), 100)
    was = {(r.shard, r.s): r.n for r in counts.collect()}
    assert sum(max(0, n - was.get((i, s), 0)) for i, s, n in got) == sum(max(0, d - own[s]) for s, d in enumerate(drawn))


def test_taken_is_brute_force(spark):
    """Words taken of each document, from the slots and the places of documents, block by block."""
    rng = random.Random(14)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(0, 90)), None, rng.choice(("a", "a", "b", None)), 0) for i in range(120)], SCHEMA)
    m = mixing.Mix(docs, block=8, shard_slots=32)
    times = Counter((r.s, r.block) for r in m.slots.collect())
    want, at = {}, {}
    for r in sorted(m.placed.collect(), key=lambda r: (r.s, r.at, r["size"])):
        assert r.at == at.get(r.s, 0)
        at[r.s] = r.at + r["size"]
        want[r.doc_id] = sum(times[r.s, w // 8] for w in range(r.at, r.at + r["size"]))
    assert {r.doc_id: r.taken for r in m.taken().collect()} == want
    spans = {r.s: r for r in mixing.intervals(m.targets, 8).collect()}
    assert {s: sum(n for (t, _), n in times.items() if t == s) for s in spans} == {s: min(r.own, 2 * r.blocks) for s, r in spans.items()}
    for key in {(r.s, r["pass"]) for r in m.slots.collect()}:
        b = [r.block for r in m.slots.collect() if (r.s, r["pass"]) == key]
        assert len(b) == len(set(b)) and max(b) < spans[key[0]].blocks


def test_mix_edges(odd, clash, none):
    m = mixing.Mix(odd, block=4)
    got = m.taken().collect()
    assert len(got) == odd.count() and sum(r["size"] for r in got) == sum(len(WORD.findall(r.text or "")) for r in odd.collect())
    assert sum(r.taken for r in got) == m.mixed().agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert sorted(map(str, mixing.Mix(clash, block=4).taken().collect())) == sorted(map(str, got))
    assert mixing.Mix(clash, block=4).mixed().columns == clash.columns
    assert mixing.Mix(none).taken().count() == 0 and mixing.Mix(none).mixed().count() == 0
    blank = odd.where("trim(text) = '' or text is null")
    assert {r.taken for r in mixing.Mix(blank).taken().collect()} == {0}


def _noted(monkeypatch, module) -> dict[str, int]:
    """Files of each intermediate table that ``module`` writes."""
    files = {}

    def noted(df, label, *rest):
        out = materialize(df, label, *rest)
        files[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(module, "materialize", noted)
    return files


@pytest.fixture
def many_parts(spark, monkeypatch):
    """Few documents in many partitions, and as many shuffle partitions, none of which Spark joins."""
    rng = random.Random(6)
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.parquet.columnarReaderBatchSize": "4096"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    made = [(i, prose(rng, 60), "en", rng.choice("abc"), 0) for i in range(400)]
    yield spark.createDataFrame(spark.sparkContext.parallelize(made, 40), SCHEMA)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_tables_of_a_mix_are_few_files_and_texts_are_read_a_few_at_a_time(spark, many_parts, monkeypatch):
    files = _noted(monkeypatch, mixing)
    mix = mixing.Mix(many_parts)
    assert mix.taken().count() == mix.rows == 400
    assert {"sizes", "draws", "counts", "slots"} <= set(files) and max(files.values()) == 1
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "256"


def test_facts_of_few_labelled_rows_are_few_files_and_texts_are_read_a_few_at_a_time(spark, many_parts, monkeypatch):
    files = _noted(monkeypatch, rules)
    labels = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert rules.judge(many_parts, labels).count() == 400 and files == {"facts": 1}
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "256"
