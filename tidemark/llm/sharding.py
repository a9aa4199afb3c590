"""Uniform shuffle into shards of exact size.

Law ``rows``: shard sizes differ by one row at most, and every arrangement of
the rows is equally likely.  A hypergeometric communication matrix says how
many rows each input partition sends to each shard; a partition permutes its
rows and hands out those numbers, rows are exchanged, and each shard is
permuted again.

The matrix is never held whole.  Its row for partition ``p`` comes from
halving the range of partitions down to ``p``: the rows that the left half
sends to each shard follow a multivariate hypergeometric law given both
halves' sizes, drawn by a generator seeded by the range.  Every task that
needs row ``p`` draws the same one, from the partitions' sizes alone.

A shard isn't one task either: the second permutation orders rows by a random
64-bit key, whose first bits deal a shard out over tasks; slots are a row's
place in its task plus the sizes of the tasks before.

Defined results: rows equal in all columns stay distinct rows; NULLs in any
column are carried along; an empty table gives an empty result; fewer rows
than shards leave some shards empty.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import clear_name, numbered

_NUMPY_BELOW = 10**9  # numpy draws from smaller populations only; from larger ones this module does, by the same law
_PI = Decimal("3.14159265358979323846264338327950288419716939937510582")
_ROW_BITS = 33  # monotonically_increasing_id: partition above, place within it below
ROWS_PER_TASK = 100_000


def shard_sizes(n: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most."""
    return np.array([n // shards + (k < n % shards) for k in range(shards)], np.int64)


def _log_factorial(n: int) -> Decimal:
    """ln n! to the digits of the context: by Stirling's series, for small numbers from the factorial."""
    if n < 1000:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + Decimal(5) / (5940 * x**9)
    return x * x.ln() - x + (2 * _PI * x).ln() / 2 + series


def _log_weight(k: int, good: int, bad: int, n: int) -> Decimal:
    """ln of C(good, k) C(bad, n - k), but for a constant."""
    return -sum(map(_log_factorial, (k, good - k, n - k, bad - n + k)))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows, taken from ``good + bad``, are good: an exact draw
    for populations of any size, in time that doesn't grow with them.

    Ratio of uniforms under the table-mountain hat of the law's mean and variance,
    which covers log-concave laws; a candidate is a step from the mode, so its
    double keeps its last digit, and is accepted by the law's own ratio to the
    mode, in 50 decimal digits.  A few rows are taken one by one.
    """
    all_ = good + bad
    few = min(n, all_ - n)  # the rows left behind are a sample as well
    if few <= 16:
        x, left_good, left = 0, good, all_
        for _ in range(few):
            hit = int(rng.integers(left)) < left_good
            x, left_good, left = x + hit, left_good - hit, left - 1
        return x if few == n else good - x
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    mode = (good + 1) * (n + 1) // (all_ + 2)
    mean, variance = Fraction(n * good, all_), Fraction(n * good * bad * (all_ - n), all_ * all_ * (all_ - 1))
    centre = float(mean - mode) + 0.5
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(float(variance) + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    with localcontext() as context:
        context.prec = 50
        top = _log_weight(mode, good, bad, n)
        while True:
            u, v = 1 - rng.random(), rng.random()  # u > 0
            k = mode + math.floor(centre + width * (v - 0.5) / u)
            if low <= k <= high and 2 * Decimal(u).ln() <= _log_weight(k, good, bad, n) - top:
                return k


def _draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows taken from a population have each label."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for k, c in enumerate(counts.tolist()):
        if n == 0:
            break
        if left == c:
            x = n
        elif left < _NUMPY_BELOW:
            x = int(rng.hypergeometric(c, left - c, n))
        else:
            x = hypergeometric(rng, c, left - c, n)
        out[k], n, left = x, n - x, left - c
    return out


def matrix_row(p: int, ends: np.ndarray, totals: np.ndarray, seed: int) -> np.ndarray:
    """Rows that partition ``p`` sends to each shard.  ``ends``: rows before
    each partition and, last, all rows; ``totals``: the shards' sizes."""
    low, high, counts = 0, len(ends) - 1, totals
    while high - low > 1:
        middle = (low + high) // 2
        left = _draw(np.random.default_rng([seed, low, high]), counts, int(ends[middle] - ends[low]))
        if p < middle:
            high, counts = middle, left
        else:
            low, counts = middle, counts - left
    return counts


def _labels(ends: np.ndarray, ids: np.ndarray, totals: np.ndarray, seed: int):
    """The shard of each row, by partition and place in it; one partition's
    labels are kept at a time."""
    at: dict[int, np.ndarray] = {}

    def label(rows: pd.Series) -> pd.Series:
        number = rows.to_numpy(np.int64)
        part, place = number >> _ROW_BITS, number & ((1 << _ROW_BITS) - 1)
        out = np.zeros(len(rows), np.int32)
        for q in np.unique(part):
            if q not in at:
                p = int(np.searchsorted(ids, q))
                at.clear()
                at[q] = np.random.default_rng([seed, len(ends), p]).permutation(
                    np.repeat(np.arange(len(totals)), matrix_row(p, ends, totals, seed)).astype(np.int32))
            mine = part == q
            out[mine] = at[q][place[mine]]
        return pd.Series(out)

    return F.pandas_udf(label, "int")


def shuffle(docs: DataFrame, shards: int = 16, seed: int = 17, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (its place
    there, gapless from 0); all columns are kept, those two names must be
    free."""
    row, part, key = (clear_name(x, docs.columns) for x in ("_row", "_part", "_key"))
    whole = numbered(docs, row)
    # the sizes of the partitions that have rows: one number each
    sizes = (whole.groupBy(F.shiftright(row, _ROW_BITS).alias(part)).agg(F.count(F.lit(1)).alias("n"))
             .toPandas().sort_values(part))
    ends = np.concatenate([[0], np.cumsum(sizes["n"].to_numpy(np.int64))]).astype(np.int64)
    totals = shard_sizes(int(ends[-1]), shards)
    label = _labels(ends, sizes[part].to_numpy(np.int64), totals, seed)
    tasks = max(-(-int(totals.max()) // ROWS_PER_TASK),
                -(-4 * int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))

    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn(shard, label(F.col(row))).withColumn(key, F.xxhash64(F.lit(seed), row))
        return df.withColumn(part, _task(F.col(key), tasks))

    # sizes of the tasks, from the row numbers alone
    counts = dealt(whole.select(row)).groupBy(shard, part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = clear_name("_base", docs.columns)
    offsets = counts.select(shard, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base))
    place = Window.partitionBy(shard, part).orderBy(key, row)
    return (dealt(whole).withColumn(slot, F.row_number().over(place)).join(offsets, [shard, part], "left")
            .withColumn(slot, (F.col(slot) - 1 + F.col(base)).cast("long")).select(*docs.columns, shard, slot))


def _task(key: Column, tasks: int) -> Column:
    """The key's range: its top 31 bits scaled to the number of tasks."""
    return F.shiftright(F.shiftrightunsigned(key, 33) * F.lit(tasks).cast("long"), 31).cast("int")
