"""Sides that are repeated over cells are many times their file, by whose size Spark chooses broadcasts; none is sent."""

from __future__ import annotations

import re

import pytest

from segmill import durable
from segmill.operators import fit, hypotheses, match
from segmill.plans import pipeline
from segmill.plans.registry import QUERIES

NAMES = [
    "distmap_qa",
    "residual_stats",
    "select_lines",
    "line_support",
    "match_accuracy",
    "nearest_distance",
    "gate_matches",
    "chamfer_hypotheses",
    "match_lines",
    "match_report",
    "coarse_best",
    "coarse_hypotheses",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_cells_are_broadcast(spark, sf_dir, name, monkeypatch):
    plans = []
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())

    def noted(df, *rest, **more):
        planned(df)
        return durable.materialize(df, *rest, **more)

    for module in (fit, hypotheses, match, pipeline):
        monkeypatch.setattr(module, "materialize", noted)
    planned(QUERIES[name](spark, sf_dir))
    joins = [x for p in plans for x in p.split("\n") if "Join [" in x and "_gx#" in x]
    assert joins and not [x for x in joins if "Broadcast" in x]


def _joins(spark, sf_dir, name, monkeypatch) -> list[str]:
    """The joins of all plans that a query runs, and of the one that it returns."""
    plans = []
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())

    def noted(df, *rest, **more):
        planned(df)
        return durable.materialize(df, *rest, **more)

    for module in (fit, hypotheses, match, pipeline):
        monkeypatch.setattr(module, "materialize", noted)
    planned(QUERIES[name](spark, sf_dir))
    return [x for p in plans for x in p.split("\n") if "Join [" in x]


@pytest.mark.parametrize("name", ["coarse_hypotheses", "coarse_best"])
def test_neither_profiles_nor_drawings_of_a_coarse_search_are_broadcast(spark, sf_dir, name, monkeypatch):
    joins = _joins(spark, sf_dir, name, monkeypatch)
    keys = [x.split("], [")[0] for x in joins]
    products = [x for x, k in zip(joins, keys, strict=True) if "level#" in k and "hyp_id#" in k and "profile#" in k]
    shifts = [x for x, k in zip(joins, keys, strict=True) if "kx#" in k and "ky#" in k]
    assert products and shifts and not [x for x in products + shifts if "Broadcast" in x]


def test_no_pixels_of_an_orientation_are_broadcast(spark, sf_dir, monkeypatch):
    joins = [x for x in _joins(spark, sf_dir, "orientation_hypotheses", monkeypatch) if "row#" in x.split("], [")[0]]
    assert joins and not [x for x in joins if "Broadcast" in x]


def test_no_pairs_of_a_match_are_broadcast(spark, sf_dir, monkeypatch):
    joins = [x for x in _joins(spark, sf_dir, "match_lines", monkeypatch) if "LeftSemi" in x or "s_id#" in x.split("], [")[0] and "p_id#" in x.split("], [")[0]]
    assert joins and not [x for x in joins if "Broadcast" in x]


def test_no_sampled_pixels_are_broadcast(spark, sf_dir, monkeypatch):
    joins = [x for x in _joins(spark, sf_dir, "distmap_qa", monkeypatch) if "lx#" in x.split("], [")[0]]
    assert joins and not [x for x in joins if "Broadcast" in x]


#: Bytes of a method up to which the virtual machine compiles it; beyond, every row is interpreted.
COMPILED = 8000


@pytest.mark.parametrize("name", ["coarse_hypotheses", "coarse_best"])
def test_generated_methods_of_a_coarse_search_are_compiled(spark, sf_dir, name, monkeypatch):
    sizes = []

    def planned(df):
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
        sizes.extend(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))

    def noted(df, *rest, **more):
        planned(df)
        return durable.materialize(df, *rest, **more)

    monkeypatch.setattr(hypotheses, "materialize", noted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plans have no code before they run
    try:
        planned(QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 10 and max(sizes) <= COMPILED
