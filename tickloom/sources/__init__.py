"""Readers and writers: ticks to bars, CSV, the synthetic source, results."""
