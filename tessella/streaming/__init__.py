"""Structured Streaming: incremental ingestion and the rolling request log."""
