"""Structured Streaming: incremental ingestion of newly landed payment files."""

from paylens.streaming.ingest import read_index, start_ingest

__all__ = ["read_index", "start_ingest"]
