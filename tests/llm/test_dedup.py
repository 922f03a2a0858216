from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from segmill.llm import line_dedup as lines
from segmill.llm import simhash

from ..conftest import rows as table
from .conftest import SCHEMA, prose


def edit1(a, b):
    """Whether one edit or none separates two lines, by the table of distances."""
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1] <= 1


def test_within_one():
    rng = random.Random(6)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))
        assert lines.within_one(a, b) == edit1(a, b)


def test_deletion_keys_meet():
    assert len(np.unique(lines.deletion_keys("abcdefg"))) == 8
    k = lambda s: set(lines.deletion_keys(s).tolist())
    whole = lambda s: lines.deletion_keys(s)[0]
    assert whole("abXcd") in k("abXYcd") and whole("abcd") in k("abXcd") and k("abXcd") & k("abYcd") and not k("abXcd") & k("pqrst")


def mutate(rng, s):
    i = rng.randrange(len(s))
    return rng.choice((s[:i] + "é" + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "q" + s[i:]))


def slow_dedup(rows):
    """Texts without the lines that go, from (id, text) rows: every line held against all earlier ones."""
    key = lambda i, t: (i is None, i or 0, int(hashlib.md5(t.encode()).hexdigest()[:15], 16))
    every = sorted((*key(i, t), n, s.strip(lines.BLANK)) for i, t in {r for r in rows if r[1] is not None} for n, s in enumerate(t.split("\n")))
    first = {}
    for *place, s in every:
        if s:
            first.setdefault(s, tuple(place))
    order = sorted(first, key=first.get)
    near = {s for k, s in enumerate(order) if len(s) >= 20 and any(edit1(s, e) for e in order[:k] if abs(len(e) - len(s)) < 2)}
    gone = {tuple(place) for *place, s in every if s and (s in near or first[s] != tuple(place))}
    return [(i, t if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if (*key(i, t), n) not in gone)) for i, t in rows], len(near)


def test_dedup_is_brute_force(spark):
    rng = random.Random(9)
    base = [prose(rng, rng.randint(4, 9)) for _ in range(30)] + ["x" * 31 + "y", "x" * 32 + "y", "x" * 63, "x" * 64, "z" * 20, "ab" * 12, "ba" * 12, "ab" * 12 + "a"]
    docs = []
    for i in range(80):
        own = [rng.choice(base) for _ in range(rng.randint(0, 5))]
        own = [mutate(rng, s) if rng.random() < 0.4 else s for s in own] + rng.choice(([], ["short"], ["  "], [prose(rng, 6)]))
        docs.append((i if i % 9 else None if i % 2 else i // 9, "\n".join(s + rng.choice(("", " ", "\t")) for s in own)))
    got = lines.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    want, near = slow_dedup(docs)
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in want) and near > 10


def test_many_neighbours_of_one_line(spark):
    """Lines that all lose a character to one key: some are near each other, some are not."""
    rng = random.Random(3)
    s = "abcdefghijklmnopqrstuvwxy"
    own = [s[:p] + c + s[p:] for p in range(0, 25, 3) for c in "0123"] + [s[:p] + c + s[p + 1 :] for p in range(0, 25, 5) for c in "45"] + ["=" * 25, "=" * 26, "=" * 24 + "-"]
    for with_key in (False, True):
        rng.shuffle(own)
        docs = list(enumerate(own + [s] if with_key else own))
        got = lines.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
        assert {r.doc_id: r.text for r in got} == dict(slow_dedup(docs)[0])


def test_short_lines_go_if_equal(spark):
    """Every length; the bound on the length holds for near matches of the later line alone."""
    rng = random.Random(4)
    base = [prose(rng, k % 4 + 1)[: 1 + k % 26] for k in range(60)] + ["a", "ab", "n" * 18 + "xy", "n" * 19 + "y"]
    docs = []
    for i in range(60):
        own = [rng.choice(base) for _ in range(rng.randint(0, 6))] + rng.choice(([], [""], ["  "]))
        docs.append((i, "\n".join(mutate(rng, s) if s.strip() and rng.random() < 0.4 else s for s in own)))
    docs.append((60, "m" * 19 + "\n" + "m" * 20 + "\n" + "k" * 20 + "\n" + "k" * 19))
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == dict(slow_dedup(docs)[0])
    assert got[60] == "m" * 19 + "\n" + "k" * 20 + "\n" + "k" * 19


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    a, other, own = ("a line of its own, number " + x for x in ("one", "two hundred", "three thousand"))
    docs = [(1, a), (2, a + "\n" + other), (2, own + "\n" + other)]
    for rows in (docs, docs[::-1]):
        got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(slow_dedup(rows)[0])
        assert any(own in r.text for r in got) and sum(other in r.text for r in got) == 1


def test_a_very_long_text_with_many_repeats(spark):
    """5 MB in 400,000 lines, half of which repeat: one pass over them, not one for each line that goes."""
    text = "\n".join(f"line {k % 200_000}" for k in range(400_000))
    began = time.time()
    r = lines.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r._dropped == 200_000 and r.text == "\n".join(f"line {k}" for k in range(200_000)) and time.time() - began < 120


def test_sql_on_odd_rows(spark, duck, odd):
    """The registered SQL over rows with nulls, repeated rows and shared ids."""
    t = odd.toArrow()  # noqa: F841
    con = duck.cursor()
    con.execute("CREATE TEMP VIEW documents AS SELECT * FROM t")
    got = lines.dedup(odd).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text")
    assert table(got) == table(con.execute(lines.ORACLE_SQL))


def test_dedup_edges(spark, odd, clash, none):
    got = lines.dedup(odd)
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(t)) for i, t in slow_dedup([(r.doc_id, r.text) for r in odd.collect()])[0])
    assert lines.dedup(none).count() == 0
    assert lines.dedup(clash).columns == [*clash.columns, "_lines__", "_dropped_"]
    assert sorted(map(str, lines.dedup(clash).select("doc_id", "text").collect())) == sorted(map(str, got.select("doc_id", "text").collect()))
    by = {(r.doc_id, r.source): r for r in got.collect()}
    assert by[3, "a"].text is None and by[4, "b"].text == "" and by[2, None].text == ""
    # Copies of a repeated row are one occurrence; the row with a null id comes after all others.
    assert [r.text for r in got.where("doc_id = 1").collect()] == [r.text for r in odd.where("doc_id = 1").collect()]
    assert by[None, None].text == ""


def slow_fingerprint(text, n=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd):
    for r in simhash.groups(odd.withColumn("t", F.col("text"))).join(odd.dropDuplicates(["doc_id"]), "doc_id").where("doc_id not in (9)").collect():
        assert r.fingerprint == f"{slow_fingerprint(r.text):016x}"


def reached(fps, bits=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("blocks,cell", [(None, 8192), (5, 8), (8, 16)])
def test_links_reach_what_brute_force_reaches(spark, blocks, cell):
    rng = random.Random(blocks or 1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(160):  # chains and balls around a few
        f = rng.choice(fps[:6] + fps[-3:])
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    edges = simhash.links(df, len(fps), blocks=blocks, cell=cell)
    assert all(bin(fps[r.u] ^ fps[r.v]).count("1") <= 3 for r in edges.collect())
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = reached(fps)
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_a_hot_cell_is_cut_and_not_copied_for_its_size(spark):
    """Fingerprints that share most of their counts: links reach what brute force reaches, by few copies of each."""
    rng = random.Random(17)
    base = rng.getrandbits(64)
    fps = sorted({base ^ rng.getrandbits(24) for _ in range(1500)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    edges = simhash.links(df, len(fps), blocks=5, cell=64)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == reached(fps)


def test_embedding_is_a_lower_bound():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << r.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 500, dtype=np.uint64))
    counts = lambda v: np.array([[(int(x) >> 2 * k & 1) + (int(x) >> 2 * k + 1 & 1) for k in range(32)] for x in v])
    d = simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b))
    assert (d == np.abs(counts(a) - counts(b)).sum(axis=1)).all() and (d <= np.bitwise_count(a ^ b)).all()


def test_groups_and_keep_one(spark, odd, clash, none):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.groups(odd).collect()}
    assert got[2, f"{slow_fingerprint(odd.where('doc_id = 2').first().text):016x}"] == 1
    zero = "0" * 16
    assert got[3, zero] == got[4, zero] == got[5, zero] == 3
    kept = simhash.keep_one(odd).collect()
    n = {}
    for r in kept:
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n == {1: 1, 3: 1, 6: 1, 7: 1, 8: 1, None: 1, 9: 1}
    assert simhash.keep_one(clash).columns == clash.columns and simhash.keep_one(clash).count() == len(kept)
    assert simhash.groups(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = prose(rng, 400, ("ka", "lo", "mi", "ne", "pu", "ri", "so")).split()
    data = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        data.append((i, " ".join(w), None, None, None))
    data += [(1000 + i, prose(rng, 200, ("ba", "de", "fi", "go", "hu")), None, None, None) for i in range(40)]
    docs = spark.createDataFrame(data, SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.groups(docs).collect()}
    fps = [slow_fingerprint(t) for _, t, *_ in data]
    want = reached(fps)
    assert [got[d[0]] for d in data] == [data[k][0] for k in want]
