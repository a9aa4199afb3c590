"""Column expressions shared by the operators (all JVM-side, codegen-able).

Numeric conventions (so results do not depend on the engine):

* money stays DECIMAL until the final division; a ratio is
  ``double(sum) / double(count-or-sum)`` — one IEEE division of exact inputs;
* rounding is half away from zero on the double, written out as
  ``floor(|x| * 10^d + 0.5) / 10^d`` (Spark's ``round`` and other engines'
  ``round`` disagree on binary near-ties such as 1.005).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import REGION_OF_STATE, UNKNOWN_REGION


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revenue(price: str | Column = "price", freight: str | Column = "freight_value") -> Column:
    """Item revenue: price + freight, at item grain."""
    return col(price) + col(freight)


def month_of(ts: str | Column) -> Column:
    """First instant of the month, as ``timestamp_ntz`` (time-zone free)."""
    return F.trunc(col(ts).cast("date"), "MM").cast("timestamp_ntz")


def delay_days(delivered: str | Column = "order_delivered_customer_date",
               estimated: str | Column = "order_estimated_delivery_date") -> Column:
    """Whole days delivered − estimated (calendar dates); negative = early."""
    return F.datediff(col(delivered).cast("date"), col(estimated).cast("date")).cast("bigint")


def delivery_bucket(delay: str | Column = "delay_days") -> Column:
    """Four-way bucket.  A NULL delay falls through to ``late`` (ELSE arm)."""
    d = col(delay)
    return (F.when(d < -10, "very_early")
             .when(d < 0, "early")
             .when(d == 0, "on_time")
             .otherwise("late"))


def late_flag(delay: str | Column = "delay_days") -> Column:
    """Two-way flag.  A NULL delay is ``not_late`` (the 4-way CASE says late)."""
    return F.when(col(delay) > 0, "late").otherwise("not_late")


def round_half(x: str | Column, digits: int = 2) -> Column:
    """Round a double half away from zero to ``digits`` places."""
    v = col(x).cast("double")
    scale = float(10 ** digits)
    return (F.when(v < 0, -F.floor(-v * scale + 0.5) / scale)
             .otherwise(F.floor(v * scale + 0.5) / scale))


def ratio(num: str | Column, den: str | Column) -> Column:
    """double(num) / double(den); NULL when den is 0 or NULL."""
    d = col(den).cast("double")
    return col(num).cast("double") / F.when(d != 0, d)


def pct(num: str | Column, den: str | Column, digits: int = 2) -> Column:
    """num / den * 100, rounded."""
    return round_half(ratio(num, den) * 100, digits)


def cents(x: str | Column) -> Column:
    """A 2-decimal money value as exact integer cents (bigint)."""
    return (col(x) * 100).cast("bigint")


def from_cents(x: str | Column) -> Column:
    """Integer cents back to money, exactly (a multiplication, no division)."""
    return (col(x).cast("decimal(20,0)") * F.lit(0.01).cast("decimal(2,2)")).cast("decimal(38,2)")


def money(x: str | Column) -> Column:
    """Money result type: decimal(38,2)."""
    return col(x).cast("decimal(38,2)")


def region_of_state(state: str | Column = "customer_state") -> Column:
    """Fixed 27-state → 5-macro-region CASE, else ``unknown``."""
    s = col(state)
    expr = None
    for region, states in REGION_OF_STATE.items():
        cond = s.isin(states)
        expr = F.when(cond, region) if expr is None else expr.when(cond, region)
    return expr.otherwise(UNKNOWN_REGION)


def half_open(ts: str | Column, start: str, end: str) -> Column:
    """``start <= ts < end`` on timestamp literals — sargable, so Parquet
    min/max statistics can skip row groups (an EXTRACT(YEAR) predicate
    cannot)."""
    c = col(ts)
    return (c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz"))
