from tidemark.functions.expressions import (  # noqa: F401
    cents, col, delay_days, from_cents, delivery_bucket, half_open, late_flag, money, month_of, pct,
    ratio, region_of_state, revenue, round_half,
)
