"""Structured Streaming: the ingest job state machine and the ingest stream."""
