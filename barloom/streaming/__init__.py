"""Streams: the batch operators' steps with state kept by Structured Streaming."""
