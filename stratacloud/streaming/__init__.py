"""Structured Streaming over camera events, and its stateful operators."""
