"""Structured Streaming forms of the operators that keep state along a stream."""
