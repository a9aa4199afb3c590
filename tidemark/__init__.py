"""tidemark — retail growth, concentration and retention analytics on Spark.

Every operator is a function from DataFrames (with the canonical retail
column names of :mod:`tidemark.schema`) to a DataFrame.  Operators only
declare logical plans; Catalyst chooses the physical strategy.
"""

from tidemark.session import get_session, materialize, release, shared_dir  # noqa: F401

__all__ = ["get_session", "materialize", "release", "shared_dir"]
