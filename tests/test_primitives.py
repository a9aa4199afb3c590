"""Distributed rank / n-tile / running sum against Spark's built-in global
window, first-event pick, and result stability across partition counts."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.primitives import RANK, RUNNING, first_event, ntile_desc, rank_desc


def _frame(spark, values):
    rows = [(i, None if v is None else Decimal(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k long, v decimal(18,2)")


def _builtin(df, k):
    w = Window.orderBy(F.col("v").desc_nulls_last(), F.col("k").asc())
    return {r["k"]: (r["t"], r["rn"], r["run"]) for r in df.select(
        "k", F.ntile(k).over(w).alias("t"), F.row_number().over(w).alias("rn"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run")).collect()}


@pytest.mark.parametrize("k", [1, 3, 4, 10, 7000])
@pytest.mark.parametrize("rows_per_bucket", [40, 10_000])
def test_ntile_and_running_match_builtin(spark, k, rows_per_bucket):
    # coarse values force many ties, and one value holds a third of the rows
    values = [str((i * 37) % 11) for i in range(600)] + ["5"] * 300 + [None] * 5
    df = _frame(spark, values)
    want = _builtin(df, k)
    ranked, n = rank_desc(df, "v", "k", rows_per_bucket=rows_per_bucket)
    assert n == len(values)
    got = {r["k"]: (r[RANK], r[RUNNING]) for r in ranked.collect()}
    assert {k_: (w[1], w[2]) for k_, w in want.items()} == got
    tiles = {r["k"]: r["tile"] for r in ntile_desc(df, "v", "k", k, sample=rows_per_bucket * 4, rows_per_bucket=rows_per_bucket).collect()}
    assert tiles == {k_: w[0] for k_, w in want.items()}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 20)), min_size=0, max_size=60),
       st.integers(1, 12), st.integers(1, 20))
def test_ntile_property(spark, values, k, rows_per_bucket):
    df = _frame(spark, [None if v is None else str(v) for v in values])
    got = {r["k"]: r["tile"] for r in ntile_desc(df, "v", "k", k, sample=rows_per_bucket + 24).collect()}
    want = {k_: w[0] for k_, w in _builtin(df, k).items()}
    assert got == want
    if values:
        sizes = {}
        for t in got.values():
            sizes[t] = sizes.get(t, 0) + 1
        assert max(sizes.values()) - min(sizes.values()) <= 1


def test_ntile_empty(spark):
    df = _frame(spark, [])
    assert ntile_desc(df, "v", "k", 4).count() == 0


def test_first_event_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [("p1", 3, None), ("p1", 2, "2020-01-02"), ("p1", 1, "2020-01-02"), ("p2", 9, "2020-01-01"),
         ("p2", 4, None)],
        "person string, order_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = first_event(df, "person", [F.col("ts").asc_nulls_last(), F.col("order_id").asc()])
    assert sorted((r.person, r.order_id) for r in out.collect()) == [("p1", 1), ("p2", 9)]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_results_stable_across_shuffle_partitions(spark, parts):
    from __spark_entry__ import queries
    from datasets import SF_SMALL
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {k: sorted(map(tuple, queries()[k](spark, SF_SMALL).collect()), key=repr)
               for k in ("spend_quartiles", "category_pareto", "counterfactual_bound")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    base = {k: sorted(map(tuple, queries()[k](spark, SF_SMALL).collect()), key=repr) for k in got}
    assert got == base


def test_selection_narrows_ties_and_text_keys(spark):
    """A value that a third of all rows share is narrowed by key; keys are text."""
    from pyspark.sql import functions as F

    from tidemark.operators.selection import rows_at, tile_ends
    df = spark.range(6000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.when(F.col("id") % 3 == 0, 7.5).when(
        F.col("id") % 50 == 1, None).otherwise(F.col("id") % 900 * 1.0).alias("v"))
    want = sorted(df.collect(), key=lambda r: (r["v"] is None, -(r["v"] or 0), r["k"]))
    ends = tile_ends(6000, 10)
    assert ends == list(range(600, 6000, 600))
    got = rows_at(df, "v", "k", ends, 6000, sample=400)
    assert [(r["v"], r["k"]) for r in got] == [(want[p - 1]["v"], want[p - 1]["k"]) for p in ends]


def test_selection_needs_a_unique_key(spark):
    from tidemark.operators.selection import rows_at
    df = spark.range(300).selectExpr("1 as v", "1 as k")
    with pytest.raises(ValueError, match="not unique"):
        rows_at(df, "v", "k", [150], 300, sample=50)


def test_ntiles_sort_and_write_nothing(spark):
    from tidemark import session
    df = spark.range(5000).selectExpr("id as k", "id % 97 as v")
    before = session.written()
    out = ntile_desc(df, "v", "k", 4)
    assert session.written() == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan.split("InMemoryRelation")[0]


def test_held_frames_do_not_stand_in_for_others(spark, scratch):
    from tidemark.session import HELD, _KEPT, hold
    spark.range(10).write.parquet(f"{scratch}/t")
    first = hold(spark.read.parquet(f"{scratch}/t"))
    assert first.count() == 10
    spark.range(5).write.mode("append").parquet(f"{scratch}/t")
    assert hold(spark.read.parquet(f"{scratch}/t")).count() == 15 and spark.read.parquet(f"{scratch}/t").count() == 15
    for _ in range(HELD + 2):
        hold(spark.range(3))
    assert len(_KEPT) == HELD
