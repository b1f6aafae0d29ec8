"""Durable jobs on Structured Streaming."""
