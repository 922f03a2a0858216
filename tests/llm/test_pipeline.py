from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from segmill.llm import common, langid, mixing, simhash
from segmill.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from ..conftest import rows
from .conftest import SCHEMA, prose
from .test_dedup import mutate, reached, slow_dedup, slow_fingerprint


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir)) == rows(duck.execute(ORACLE_SQL[name]))


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(QUERIES) <= names and "pipeline" in names and len([n for n in names if n.startswith("op")]) == 10


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.materialize(stage(spark, docs, sf_dir), "test")
        if k < 4:
            assert out.columns == start.columns, name
        if k == 0:
            assert out.count() >= 0.98 * docs.count()
        if k == 1:
            assert out.count() == docs.count() and out.agg({"n_chars": "sum"}).first()[0] < docs.agg({"n_chars": "sum"}).first()[0]
        if k == 2:
            groups = simhash.groups(docs)
            assert out.count() == groups.select("component_id").distinct().count()
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.component_id for r in groups.collect()}
        docs = out
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(docs.columns)


def test_every_stage_is_brute_force(spark, tmp_path):
    """Each stage over a small corpus against a slow version of its own, on what the stage before it returned."""
    rng = random.Random(41)
    langs = {"en": ("the", "on", "er", "ing"), "de": ("sch", "ung", "ein", "ü"), "fr": ("eau", "ç", "ent", "é")}
    shared = [prose(rng, 7) for _ in range(6)]
    data = []
    for i in range(150):
        lang = rng.choice(list(langs))
        text = "\n".join(prose(rng, rng.randint(5, 25), langs[lang]) for _ in range(rng.randint(1, 5)))
        text += rng.choice(("", "", "\n" + rng.choice(shared), "\n" + mutate(rng, rng.choice(shared))))
        data.append((i, text, lang, rng.choice(("a", "a", "b", None)), len(text)))
    data += [(200, None, "en", "a", None), (201, "123 !!", "en", "b", 6), (202, data[3][1], "en", "b", 0), (203, data[4][1], None, "a", 0), (None, data[5][1], "en", "a", 0), (7, prose(rng, 30), "en", "a", 0)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    text_of = lambda df: sorted(((str(r.doc_id), r.text) for r in df.collect()), key=str)

    model = langid.train(docs.where(common.fold("doc_id") != 2))
    kept = common.materialize(stage["language ID"](spark, docs, ""), "t")
    want = [(i, t, s) for i, t, _, s, _ in data if (r := langid.score_texts([t], model))[0][0] != "und" and r[1][0] >= corpus_pipeline.MIN_SCORE]
    assert text_of(kept) == sorted(((str(i), t) for i, t, _ in want), key=str) and len(want) >= 150

    lined = common.materialize(stage["line dedup"](spark, kept, ""), "t")
    assert text_of(lined) == sorted(((str(i), t) for i, t in slow_dedup([(i, t) for i, t, _ in want])[0]), key=str)

    rows = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.source) for r in lined.collect())
    root = reached([slow_fingerprint(r[2]) for r in rows])
    for k in range(1, len(rows)):  # rows that share an id are of one group
        if rows[k][:2] == rows[k - 1][:2] and not rows[k][0]:
            root = [root[k - 1] if r == root[k] else r for r in root]
    first = {}
    for k, r in enumerate(root):
        first.setdefault(r, rows[k])
    one = common.materialize(stage["SimHash near-dedup"](spark, lined, ""), "t")
    groups = [sum(x == r for x in root) for r in first]
    assert one.count() == len(first) and max(groups) > 1
    assert {r.doc_id for r in one.collect()} == {None if n else i for n, i, _, _ in first.values()}

    mixed = common.materialize(stage["mixing"](spark, one, ""), "t")
    m = mixing.Mix(one)
    slots = {(r.s, r["pass"], r.block) for r in m.slots.collect()}
    texts = {r.doc_id: r.text for r in one.collect()}
    want = []
    for r in m.placed.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        for turn in (0, 1):
            taken = [w for k, w in enumerate(words) if (r.s, turn, (r.at + k) // m.block) in slots]
            if taken:
                want.append((str(r.doc_id), " ".join(taken)))
    assert sorted((str(r.doc_id), " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in mixed.collect()) == sorted(want)

    own = Tokenizer.from_file(tokenizer_path())
    ids = [[*own.encode(r.text or "", add_special_tokens=False).ids, 1] for r in mixed.collect()]
    pieces = [(len(x), at, zlib.crc32(np.array(x[at : at + 2048], "<u4").tobytes())) for x in ids for at in range(0, len(x), 2048)]
    packed = stage["packing"](spark, mixed, "").collect()
    assert sorted((r.doc_tokens, r.start, r.ids_crc32) for r in packed) == sorted(pieces)
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048 for s in by.values())


def test_line_stage_drops_equal_short_lines(spark):
    docs = spark.createDataFrame([(1, "one\ntwo", "en", "a", 7), (2, "two\nsix", "en", "a", 7)], SCHEMA)
    out = corpus_pipeline.lines(spark, docs, "")
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, "one\ntwo", 7), (2, "six", 3)}


def test_run_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
