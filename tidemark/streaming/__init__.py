"""Structured Streaming ingest of result shards."""
