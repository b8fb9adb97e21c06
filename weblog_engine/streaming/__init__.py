"""Structured Streaming jobs: event decode, 5-minute windows, alerts."""
