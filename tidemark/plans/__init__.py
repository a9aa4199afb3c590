"""Query plans: the catalogue of operator compositions over the driver's
tables (``catalog``) and the equivalent reference SQL (``oracle``)."""

from tidemark.plans.catalog import build as build_queries  # noqa: F401
from tidemark.plans.oracle import build as build_oracle  # noqa: F401
