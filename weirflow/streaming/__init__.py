"""Structured Streaming: deduplicated ingestion, velocity windows and running provenance."""
