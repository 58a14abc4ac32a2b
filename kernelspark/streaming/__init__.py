"""Streaming: scoring a stream with a fitted model."""
