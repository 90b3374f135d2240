"""Structured Streaming variant of the daily metrics refresh."""
