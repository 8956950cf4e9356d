"""Plans over streams: the same row operators and grouped aggregates, run by Structured Streaming."""

from millrace.streaming.streams import run_once, stream_parquet

__all__ = ["run_once", "stream_parquet"]
