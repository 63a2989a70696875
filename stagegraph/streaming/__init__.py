"""Structured Streaming: event counts, throttled notifications, tailing."""
