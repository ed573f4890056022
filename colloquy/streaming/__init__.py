"""Structured Streaming extensions: staleness states and pauses."""
