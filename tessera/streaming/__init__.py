"""Incremental, resumable batch logs on Structured Streaming."""
