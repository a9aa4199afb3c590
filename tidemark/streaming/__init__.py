"""Structured Streaming: incremental bronze → silver ingest of raw exports."""

from tidemark.streaming.ingest import read_bronze_stream, stream_to_silver  # noqa: F401
