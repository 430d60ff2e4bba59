"""Stateful forms for Structured Streaming."""
