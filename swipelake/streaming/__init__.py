"""Micro-batch ingest on Structured Streaming."""
