"""Every registered query of the engine against its SQL, over whole small tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from cuewright.plans import extensions, feeds, files, flows, images, landed, media, quality, repairs, rules, text

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
OWN = media.QUERIES | text.QUERIES | landed.QUERIES | rules.QUERIES | flows.QUERIES | feeds.QUERIES | images.QUERIES | extensions.QUERIES | quality.QUERIES | files.QUERIES | repairs.QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in OWN.items() if sql])
def test_equals_sql(spark, con, name):
    query, sql = OWN[name]
    same_columns, extra, missing = differences(spark, con, query, sql, SF)
    assert same_columns
    assert not extra and not missing


@pytest.mark.parametrize("name", [n for n, (_, sql) in OWN.items() if not sql])
def test_runs(spark, name):
    assert OWN[name][0](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dimensions_do_not_multiply(spark):
    """Plans without a Cartesian product, and without Python where native is promised."""
    for name in ("best_release", "compat_reasons", "queue_health", "text_metrics", "monotonic_dts"):
        plan = OWN[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan


def _plan(spark, name):
    return OWN[name][0](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_sketches_are_not_kept_by_user(spark):
    """no aggregate by user holds a sketch of distinct users."""
    plan = OWN["approximations"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any("user_id" in line.split("functions=")[0] for line in plan.splitlines() if "Aggregate(key" in line and "approx_count_distinct" in line)


def test_probes_are_read_once(spark):
    """languages, bitmaps and tags come from one pass over the streams."""
    assert _plan(spark, "probed_files").count("from_json") == 1


def test_logs_are_searched_once(spark):
    """scores and counts come from one pass over the lines."""
    assert sum("Relation [l_" in line for line in _plan(spark, "run_logs").splitlines()) == 2


def test_heavy_rows_are_spread(spark):
    """rows of one row group are worked on by many tasks, and a document's joined lines are scored once."""
    for name in ("settings", "recognised_documents"):
        assert "RepartitionByExpression" in _plan(spark, name)
    assert _plan(spark, "recognised_documents").count("made(") <= 2
