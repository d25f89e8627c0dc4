"""Incremental ingestion with Structured Streaming."""
