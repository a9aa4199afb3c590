"""Physical-plan properties the scale design relies on."""

import contextlib
import io

import pytest

from datasets import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="extended")
    return buf.getvalue()


def _keys():
    from __spark_entry__ import queries
    from tidemark.plans import build_queries  # the optional queries are not bound to be free of Python
    return sorted(build_queries())


@pytest.fixture(scope="module")
def shuffled(spark):
    """Plans as they look when no side is small enough to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("key", _keys())
def test_no_python_udf_no_cartesian(shuffled, key):
    from __spark_entry__ import queries
    p = plan(queries()[key](shuffled, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{key}: {bad}"


def test_first_event_limits_before_shuffle(shuffled):
    from __spark_entry__ import queries
    p = plan(queries()["first_delivered_order"](shuffled, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_rank_windows_are_per_bucket(shuffled):
    from pyspark.sql import functions as F

    from tidemark.operators.primitives import rank_desc
    df = shuffled.range(0, 5000).select(F.col("id").alias("k"), (F.col("id") % 17).alias("v"))
    ranked, n = rank_desc(df, "v", "k", rows_per_bucket=500)
    p = plan(ranked)
    assert n == 5000
    assert "windowspecdefinition(_bucket" in p
    assert ranked.select("_bucket" if "_bucket" in ranked.columns else "k").count() == 5000


def test_date_window_pushed_to_scan(shuffled):
    from __spark_entry__ import queries
    p = plan(queries()["platform_growth"](shuffled, SF_SMALL))
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(o_orderdate" in p


def test_fanout_total_never_joins_items_to_payments_rowwise(shuffled):
    from __spark_entry__ import queries
    p = plan(queries()["revenue_fanned_out"](shuffled, SF_SMALL))
    # both sides are aggregated per order before the joins
    assert p.count("HashAggregate(keys=[order_id") >= 2
