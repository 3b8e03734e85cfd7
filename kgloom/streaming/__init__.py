"""Structured Streaming: micro-batch ingestion, windows over spans, deduplication, a running identity registry."""
