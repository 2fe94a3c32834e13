"""Structured Streaming form of the weekly screening loop."""
