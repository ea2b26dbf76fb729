"""Structured Streaming: ticks to bars, the paper trader."""
