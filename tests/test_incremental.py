"""Incremental silver: replays, corrections, late files, lost drivers; the batch load's totals and rejects."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources.incremental import TABLE_KEYS, VERSION, apply_batch, current
from tidemark.sources.native import LoadMismatch, load_silver
from tidemark.schema import BRONZE_COLUMNS
from test_native import RAW

ITEMS = BRONZE_COLUMNS["order_items"]


def _items(spark, rows):
    """(order, item, price, version); price None: the row has no key."""
    full = [(None if o is None else str(o), str(i), "p", "s", "2018-01-01 00:00:00", price, "1.00", v) for o, i, price, v in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in ITEMS) + f", {VERSION} long")


def _prices(spark, path):
    return {(r.order_id, r.order_item_id): str(r.price) for r in current(spark, path).collect()}


def _files(path):
    return sorted((os.path.join(d, f), os.path.getmtime(os.path.join(d, f))) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_replays_change_nothing_and_corrections_replace_their_row(spark, scratch):
    path = f"{scratch}/items"
    first = _items(spark, [(o, 1, f"{o}.50", 10) for o in range(40)])
    assert apply_batch(first, 0, "order_items", path, parts=8) == {"changed": 40, "parts": 8}
    before = _files(path)
    for batch in (0, 1):  # the same batch run again; the same file delivered again
        assert apply_batch(first, batch, "order_items", path, parts=8)["changed"] == 0
    assert _files(path) == before
    late = _items(spark, [(3, 1, "99.00", 20), (3, 2, "5.00", 20), (4, 1, "4.50", 30)])  # a correction, a new row, the same values again
    done = apply_batch(late, 2, "order_items", path, parts=8)
    assert done["changed"] == 2 and done["parts"] <= 2
    assert len(set(before) - set(_files(path))) <= 2  # other parts' files stay as they are
    want = {(str(o), "1"): f"{o}.50" for o in range(40)} | {("3", "1"): "99.00", ("3", "2"): "5.00"}
    assert _prices(spark, path) == want
    assert apply_batch(first, 3, "order_items", path, parts=8)["changed"] == 0  # an old file can't undo the correction
    assert _prices(spark, path) == want
    assert current(spark, path).columns == ITEMS


def test_latest_of_a_batch_counts(spark, scratch):
    path = f"{scratch}/items"
    apply_batch(_items(spark, [(1, 1, "1.00", 5), (1, 1, "3.00", 7), (1, 1, "2.00", 6)]), 0, "order_items", path)
    assert _prices(spark, path) == {("1", "1"): "3.00"}


def test_rejects_are_kept_by_batch(spark, scratch):
    path, bad = f"{scratch}/items", f"{scratch}/bad"
    rows = _items(spark, [(1, 1, "1.00", 1), (2, 1, "dear", 1), (3, 1, "1.005", 1), (None, 1, "1.00", 1)])
    for _ in range(2):
        apply_batch(rows, 7, "order_items", path, bad)
        assert spark.read.parquet(bad).where("batch_id = 7").count() == 3
    assert _prices(spark, path) == {("1", "1"): "1.00"}
    with pytest.raises(Exception, match="no decimal|no key"):
        apply_batch(rows, 8, "order_items", path)


def test_a_staged_batch_is_put_in_place_after_a_lost_driver(spark, scratch, monkeypatch):
    path = f"{scratch}/items"
    apply_batch(_items(spark, [(1, 1, "1.00", 1)]), 0, "order_items", path, parts=4)
    # the driver was lost after staging: the folder is complete, the table is as before
    staged = spark.read.parquet(path).withColumn("price", F.lit("8.00").cast("decimal(18,2)"))
    staged.write.partitionBy("_part").parquet(f"{path}/_staging/batch_id=1")
    assert _prices(spark, path) == {("1", "1"): "1.00"}
    apply_batch(_items(spark, [(1, 1, "8.00", 2)]), 1, "order_items", path, parts=4)
    assert _prices(spark, path) == {("1", "1"): "8.00"}
    assert not os.path.exists(f"{path}/_staging/batch_id=1")


def test_every_keyed_table_has_its_key(spark):
    assert set(TABLE_KEYS) == set(BRONZE_COLUMNS) - {"geolocation"}
    assert all(set(keys) <= set(BRONZE_COLUMNS[t]) for t, keys in TABLE_KEYS.items())


def test_an_empty_batch_changes_nothing(spark, scratch):
    path = f"{scratch}/items"
    assert apply_batch(_items(spark, []), 0, "order_items", path)["changed"] == 0
    apply_batch(_items(spark, [(1, 1, "1.00", 1)]), 1, "order_items", path)
    assert apply_batch(_items(spark, []), 2, "order_items", path)["changed"] == 0


# --- the batch load ---

@pytest.fixture()
def raw(scratch):
    root = os.path.join(scratch, "raw")
    os.makedirs(root)
    for table, text in RAW.items():
        with open(os.path.join(root, f"{table}.csv"), "w") as f:
            f.write(text)
    return root


def _totals(df):
    return {(r.tbl, r.measure): r.value for r in df.collect()}


def test_totals_are_measured_while_writing(spark, scratch, raw):
    totals = load_silver(spark, raw, f"{scratch}/silver")
    got = _totals(totals)
    assert got["orders", "raw_rows"] == got["orders", "rows"] == 4
    assert str(got["order_items", "price"]) == "120027.00" and str(got["geolocation", "geolocation_lat"]) == "-50.19"
    load_silver(spark, raw, f"{scratch}/again", manifest=totals)
    assert sorted(os.listdir(f"{scratch}/again")) == sorted(os.listdir(f"{scratch}/silver"))


def test_a_short_file_fails_the_load_and_leaves_the_old_tables(spark, scratch, raw):
    manifest = load_silver(spark, raw, f"{scratch}/silver")
    with open(f"{raw}/order_items.csv", "w") as f:
        f.write("\n".join(RAW["order_items"].splitlines()[:-1]) + "\n")
    with pytest.raises(LoadMismatch, match=r"order_items.rows: announced 4.00, loaded 3.00"):
        load_silver(spark, raw, f"{scratch}/silver", manifest=manifest)
    assert spark.read.parquet(f"{scratch}/silver/order_items_clean").count() == 4


def test_ragged_and_bad_rows_go_aside(spark, scratch, raw):
    with open(f"{raw}/order_items.csv", "a") as f:
        f.write("o4,2,p3\no4,3,p3,s3,2018-03-06 00:00:00,cheap,0.70\n")
    with pytest.raises(Exception):
        load_silver(spark, raw, f"{scratch}/strict")
    got = _totals(load_silver(spark, raw, f"{scratch}/silver", reject_root=f"{scratch}/bad"))
    assert (got["order_items", "raw_rows"], got["order_items", "rows"]) == (6, 4)
    assert os.listdir(f"{scratch}/bad") == ["order_items"]
    assert spark.read.parquet(f"{scratch}/bad/order_items").count() == 2
