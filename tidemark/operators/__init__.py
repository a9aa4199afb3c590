"""Retail analytics operators: pure functions DataFrame(s) → DataFrame."""

from tidemark.operators import (  # noqa: F401
    concentration, customers, delivery, growth, primitives, quality, retention, series,
)
