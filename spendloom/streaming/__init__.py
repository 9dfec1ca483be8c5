"""Incremental upsert as a stream."""
