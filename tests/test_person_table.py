"""The person table: first delivered order by packed order, cells and rollup."""

import random

import pytest

from datasets import SF_SMALL
from tidemark.operators import delivery, retention as ret


def _tables(spark, text_ids):
    """Persons with several records, equal purchase times, NULL times, estimates, states and deliveries."""
    rng = random.Random(4)
    times = [None, "0001-01-02 00:00:00", "1969-12-31 23:59:59.999999", "2017-03-26 02:30:00", "2017-03-26 02:30:00.000001",
             "9999-12-31 23:59:59.999999", "2018-01-01 00:00:00"]
    states = ["SP", "RJ", "AM", "XX", None]
    customers = [(c, f"p{c % 90}", rng.choice(states)) for c in range(300)]
    ids = [-9223372036854775808, -1, 0, 9223372036854775807, *range(1, 700)]
    orders = []
    for k in ids:
        delivered = rng.choice([None, "2018-02-01 00:00:00", "2018-02-05 00:00:00"])
        orders.append((str(k) if text_ids else k, rng.randrange(300), rng.choice(times), delivered,
                       rng.choice([None, "2018-02-03 00:00:00"])))
    cast = lambda *cs: [f"cast({c} as timestamp_ntz) {c}" for c in cs]
    kind = "string" if text_ids else "long"
    return (spark.createDataFrame(customers, "customer_id long, customer_unique_id string, customer_state string"),
            spark.createDataFrame(orders, f"order_id {kind}, customer_id long, {ret.PURCHASE} string, {ret.DELIVERED} string, "
                                          f"{ret.ESTIMATED} string").selectExpr(
                "order_id", "customer_id", *cast(ret.PURCHASE, ret.DELIVERED, ret.ESTIMATED)))


def _plain(customers, orders):
    record = {r.customer_id: r for r in customers.collect()}
    persons = {}
    for o in orders.collect():
        c = record[o.customer_id]
        persons.setdefault(c.customer_unique_id, []).append((o, c.customer_state))
    out = {}
    for person, held in persons.items():
        done = [(o[ret.PURCHASE] is None, str(o[ret.PURCHASE] or ""), o.order_id, o, state) for o, state in held if o[ret.DELIVERED]]
        if done:
            _, _, _, o, state = min(done, key=lambda x: x[:3])
            delay = None if o[ret.ESTIMATED] is None else (o[ret.DELIVERED].date() - o[ret.ESTIMATED].date()).days
            out[person] = (state, delay, len({o.order_id for o, _ in held}) >= 2)
    return out


@pytest.mark.parametrize("text_ids", [False, True])
def test_person_table_against_plain_python(spark, text_ids):
    customers, orders = _tables(spark, text_ids)
    want = _plain(customers, orders)
    got = ret.person_table(customers, orders, {"state": customers["customer_state"]})
    assert {r.customer_unique_id: (r.state, r.delay_days, bool(r.returned)) for r in got.collect()} == want
    cells = {}
    for state, delay, back in want.values():
        key = (state, "late" if delay is not None and delay > 0 else "not_late")
        n, r = cells.get(key, (0, 0))
        cells[key] = (n + 1, r + back)
    assert {(r[0], r[1]): (r[2], r[3]) for r in ret.exposure_cells(customers, orders).collect()} == cells
    rolled = [r.asDict() for r in ret.exposure_rollup(customers, orders).collect()]
    for level, keep in (("state", 2), ("region", 2), ("total", 1)):
        assert sum(r["customers"] for r in rolled if r["level"] == level) == len(want)
    total = {r["delivery_bucket"]: r["customers"] for r in rolled if r["level"] == "total"}
    assert total == {r.delivery_bucket: r.customers for r in ret.exposure_rate(customers, orders).collect()}
    thin = ret.thin_cells(ret.cell_sizes(customers, orders), floor=9).first()
    states = {s for s, _ in cells}
    assert (thin.cells, thin.thin) == (2 * len(states), sum(cells.get((s, f), (0, 0))[0] < 9 for s in states for f in ("late", "not_late")))


def test_unknown_delay_is_late_of_four_and_not_late_of_two(spark):
    customers, orders = _tables(spark, False)
    one = spark.createDataFrame([(None,), (-11,), (-10,), (-1,), (0,), (1,)], "delay_days long")
    from tidemark.functions import delivery_bucket, late_flag
    got = one.select(delivery_bucket().alias("four"), late_flag().alias("two")).collect()
    assert [r.four for r in got] == ["late", "very_early", "early", "early", "on_time", "late"]
    assert [r.two for r in got] == ["not_late"] * 5 + ["late"]
    assert delivery.early_share(orders).count() == 1


@pytest.mark.parametrize("key", ["region_return_rate", "region_gap", "delivery_return_rate", "counterfactual_bound",
                                 "state_cell_sizes", "thin_cells", "exposure_rollup"])
def test_one_scan_of_orders_and_no_sort_aggregate(spark, key):
    from __spark_entry__ import queries
    plan = queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/orders.parquet") == 1
    assert "SortAggregate" not in plan and "Window" not in plan
