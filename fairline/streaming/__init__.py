"""Structured Streaming forms of quote ingest, pick recording and settlement."""
