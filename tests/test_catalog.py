"""Every query with an SQL counterpart gives its values, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_queries import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = entry_module.queries()[name](spark, SF)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = duck.sql(entry_module.oracle_sql()[name])
    assert mine == rows_of(result.columns, result.fetchall())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 5


def test_correlations_are_worked_out_once(spark):
    from yieldscope.catalog import preparing
    plan = preparing.rho(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_clustering_report_is_whole(spark, monkeypatch):
    """The query hands no size of its own to the report: searches, starts and forests are the operator's."""
    from yieldscope.catalog import models
    asked = []

    class Asked(Exception):
        pass

    def report(obs, *sizes, **named):
        asked.append((sizes, named))
        raise Asked

    monkeypatch.setattr(models.reports, "clustering_report", report)
    with pytest.raises(Asked):
        entry_module.queries()["m29_clustering_report"](spark, SF)
    assert asked == [((), {})]
