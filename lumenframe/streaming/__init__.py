"""Bounded Structured Streaming runs."""
