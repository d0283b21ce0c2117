"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import subprocess
import sys

import pytest
from compare import connect, differences
from conftest import ROOT

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tailward.operators.features import FEATURES
from tailward.plans.catalog import QUERIES
from tailward.plans.oracle import ORACLES as SQL
from tailward.plans.products import Products

WITHOUT_SQL = {"a1_bc_fit", "a1_tuning_sweep", "a2_bc_score", "a5_adaptive_alerts"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_entry_points_load_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_entry_points_hold_every_query():
    assert QUERIES.keys() <= entry_points.queries().keys() and SQL.keys() <= entry_points.oracle_sql().keys()


def test_every_query_has_sql():
    assert QUERIES.keys() - SQL.keys() == WITHOUT_SQL
    assert not SQL.keys() - QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == []


def test_entry_gives_one_row_per_variety(spark):
    rows = entry_points.entry(spark).collect()
    assert sorted(r.variety for r in rows) == list(range(6))
    assert all(0 <= r.level <= 3 for r in rows)


def test_model_scores_are_probabilities(spark, sf_dir):
    scores = [r.score for r in QUERIES["a2_bc_score"](spark, sf_dir).collect()]
    assert scores and all(0.0 <= s <= 1.0 for s in scores)


def test_model_coefficients_are_finite(spark, sf_dir):
    """A weight is null exactly for a feature without any value to learn from."""
    p = Products.of_fixture(spark, sf_dir)
    rows = {r.feature: r.weight for r in QUERIES["a1_bc_fit"](spark, sf_dir).collect()}
    learned = p.training(p.labelled).agg(*[F.count(f"z_{c}").alias(c) for c in FEATURES]).first().asDict()
    assert rows.keys() == {*FEATURES, "(intercept)"}
    for name, weight in rows.items():
        assert (weight is None) == (learned.get(name, 1) == 0)
        assert weight is None or abs(weight) < 100
