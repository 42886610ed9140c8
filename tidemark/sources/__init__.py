"""Scans, sinks and checkpoint-shard storage."""
