"""Exact distributed selection: the rows at given places of a total order.

N-tiles need k - 1 rows of a frame, not its order.  :func:`rows_at` finds them
by narrowing ranges, without a sort or a written table:

1. every wanted place starts with the whole order as its open range;
2. about ``SAMPLE`` rows of the open ranges (picked by a hash of the row) give
   a bracket around each place, four standard deviations to either side;
3. one aggregate counts how many rows lie up to each end of each bracket:
   partial counts, one row a task.  The counts are exact, so the part that
   holds the place is known for certain, also when the bracket missed it;
4. when no more than ``SAMPLE`` rows are open they come to the driver, sorted, and
   the rows wanted are among them by position.

Ranges are over (value, key) together, so a value that a third of all rows
share is narrowed by key like any other.  Each round narrows a range by a factor of the
square root of its sample; ten billion rows take about five.

Rows order by value descending, NULLs last, then key ascending, NULLs last; the key
must be unique.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.session import hold

SAMPLE = 16_384  # rows that the driver sees at a time; each has a value and a key
SAMPLE_CONF = "tidemark.select.sample"  # session setting overriding it
_BINS = 1 << 32


def ordering(value: str, key: str) -> list[Column]:
    return [F.col(value).desc_nulls_last(), F.col(key).asc_nulls_last()]


def after(value: str, key: str, row: Row, types: dict[str, str]) -> Column:
    """Whether a row comes after ``row`` in the order (never NULL)."""
    v, k = F.col(value), F.col(key)
    later_key = F.lit(False) if row[1] is None else k.isNull() | (k > F.lit(row[1]).cast(types[key]))
    if row[0] is None:
        return v.isNull() & later_key
    at = F.lit(row[0]).cast(types[value])
    return v.isNull() | (v < at) | ((v == at) & later_key)


@dataclass
class _Range:
    """Rows after ``low`` up to ``high`` (None: no end); ``before`` rows lie up to ``low``."""
    low: Row | None
    high: Row | None
    before: int
    size: int

    def holds(self, value: str, key: str, types: dict[str, str]) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & after(value, key, self.low, types)
        if self.high is not None:
            inside = inside & ~after(value, key, self.high, types)
        return inside


def _merged(ranges: dict[int, _Range]) -> dict[int, _Range]:
    """Ranges that overlap become one."""
    out: dict[int, _Range] = {}
    last: _Range | None = None
    for p, r in sorted(ranges.items(), key=lambda x: (x[1].before, x[1].size)):
        if last is not None and r.before < last.before + last.size:
            if r.before + r.size > last.before + last.size:
                last.high, last.size = r.high, r.before + r.size - last.before
        else:
            last = _Range(r.low, r.high, r.before, r.size)
        out[p] = last
    return out


def rows_at(df: DataFrame, value: str, key: str, places: list[int], n: int, sample: int | None = None) -> list[Row]:
    """The rows (value, key) at the 1-based ``places`` of the order; ``n``: rows of ``df``."""
    if sample is None:
        sample = int(df.sparkSession.conf.get(SAMPLE_CONF, str(SAMPLE)))
    rows = df.select(value, key)
    types = dict(rows.dtypes)
    ranges = {p: _Range(None, None, 0, n) for p in places}
    rounds = idle = 0
    while True:
        rounds += 1
        picked = F.pmod(F.xxhash64(F.lit(rounds), value, key), F.lit(_BINS))  # another sample each round
        distinct = {(r.before, r.size): r for r in ranges.values()}
        open_rows = sum(r.size for r in distinct.values())
        whole = any(r.size == n for r in distinct.values())
        within = rows if whole else rows.where(reduce(lambda a, b: a | b, (r.holds(value, key, types) for r in distinct.values())))
        if open_rows <= sample:
            held = within.orderBy(*ordering(value, key)).collect()
            first, at = {}, 0
            for before, size in sorted(distinct):
                first[before, size] = at
                at += size
            return [held[first[r.before, r.size] + p - r.before - 1] for p, r in ((p, ranges[p]) for p in places)]
        # the sample, in order, with the open range that each of its rows is in
        owner = reduce(lambda c, kv: c.when(kv[1].holds(value, key, types), F.lit(kv[0])),
                       list(enumerate(distinct.values()))[1:],
                       F.when(next(iter(distinct.values())).holds(value, key, types), F.lit(0)))
        seen = (within.where(picked < int(_BINS * sample / open_rows)).withColumn("_range", owner)
                .orderBy(*ordering(value, key)).collect())
        by_range: dict[tuple[int, int], list[Row]] = {k: [] for k in distinct}
        names = list(distinct)
        for r in seen:
            by_range[names[r["_range"]]].append(r)
        sharing = Counter((r.before, r.size) for r in ranges.values())
        ends: dict[int, tuple[Row | None, Row | None]] = {}
        for p, r in ranges.items():
            held = by_range[r.before, r.size]
            at, margin = (p - r.before) / r.size * len(held), max(1.0, min(2 * len(held) ** 0.5, len(held) / (4 * sharing[r.before, r.size])))
            low, high = int(at - margin), int(at + margin)
            ends[p] = (held[low] if 0 <= low < len(held) else r.low, held[high] if 0 <= high < len(held) else r.high)
        counts = [F.count_if(within_range & ~after(value, key, end, types)).alias(f"c{p}_{side}")
                  for p, pair in ends.items() for within_range in [ranges[p].holds(value, key, types)]
                  for side, end in enumerate(pair) if end is not None]
        got = within.agg(*counts).first().asDict() if counts else {}
        for p, r in ranges.items():
            low, high = ends[p]
            upto_low = r.before + (got[f"c{p}_0"] if low is not None and low is not r.low else 0)
            upto_high = r.before + (got[f"c{p}_1"] if high is not None and high is not r.high else r.size)
            if p <= upto_low:  # the bracket missed it
                new = _Range(r.low, low, r.before, upto_low - r.before)
            elif p > upto_high:
                new = _Range(high, r.high, upto_high, r.before + r.size - upto_high)
            else:
                new = _Range(low, high, upto_low, upto_high - upto_low)
            ranges[p] = new
        ranges = _merged(ranges)
        idle = 0 if sum({(r.before, r.size): r.size for r in ranges.values()}.values()) < open_rows else idle + 1
        if idle == 20:
            raise ValueError(f"{key} is not unique: {open_rows} rows can't be told apart")


def tile_ends(n: int, k: int) -> list[int]:
    """The last place of each of ``k`` n-tiles but the last: the first ``n mod k`` tiles hold one row more."""
    q, more = divmod(n, k)
    return [p for t in range(1, k) if 0 < (p := t * q + min(t, more)) < n]


def ntile_by_cuts(df: DataFrame, value: str, key: str, k: int, alias: str, sample: int | None = None) -> DataFrame:
    """``NTILE(k) OVER (ORDER BY value DESC NULLS LAST, key)`` by the k - 1 rows that end a tile: one scan compares with them.

    ``df`` is computed once: it is held by the session's executors (see
    :func:`tidemark.session.hold`) for the counts and for the scan that assigns tiles."""
    held = hold(df)
    n = held.count()
    # with fewer rows than tiles every row ends one: the places are distinct
    ends = list(dict.fromkeys(tile_ends(n, k)))
    types = dict(held.dtypes)
    passed = [after(value, key, row, types).cast("bigint") for row in (rows_at(held, value, key, ends, n, sample) if ends else [])]
    return held.withColumn(alias, reduce(lambda a, b: a + b, passed, F.lit(1).cast("bigint")))
