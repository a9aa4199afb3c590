"""Sources and sinks: raw text (bronze) readers, silver typing and the
Parquet sink, and bindings of other schemas to the canonical shape."""

from tidemark.sources.bronze import read_bronze, read_bronze_all, row_counts, to_bronze  # noqa: F401
from tidemark.sources.silver import silver, write_silver  # noqa: F401
from tidemark.sources.tpch import Tables, tpch_tables  # noqa: F401
