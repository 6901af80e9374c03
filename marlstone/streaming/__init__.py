"""Structured Streaming ingestion and stateful replay."""
