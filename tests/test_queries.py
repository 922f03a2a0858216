"""Every registered query against its SQL, and the shape of those that SQL can't express."""

from __future__ import annotations

import pytest

from segmill.plans import registry
from segmill.plans.registry import ORACLE_SQL, QUERIES
from segmill.sources import derived, svg

from .conftest import rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir)) == rows(duck.execute(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"ransac_fit", "full_pipeline", "match_report"}))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["raster_scale", "preprocess"])
def test_covers_all_documents(spark, sf_dir, name):
    ids = {r.doc_id for r in derived.pages(spark, sf_dir).select("doc_id").collect()}
    assert len(ids) > 4 and {r.doc_id for r in QUERIES[name](spark, sf_dir).collect()} == ids


def test_entry_module():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(q)


def test_joins_are_not_nested_loops(spark, sf_dir):
    for name in ("grid_radius_join", "gate_matches", "candidate_pairs", "nearest_distance", "label_pairs", "neighbor_signature"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_drawings_are_written_in_order_of_ids(spark, sf_dir, tmp_path):
    for table, key in (("orders", "o_orderkey"), ("part", "p_partkey")):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3, key).sortWithinPartitions(key, ascending=False).write.parquet(f"{tmp_path}/{table}.parquet")
    want = sorted((r.doc_id, r.txt_id, r.text) for r in derived.labels(spark, sf_dir).collect())
    found = sorted((r.doc_id, r.txt_id, r.text) for r in svg.texts(registry._written(spark, str(tmp_path))).collect())
    assert [(a, c) for a, _, c in found] == [(a, c) for a, _, c in want]
