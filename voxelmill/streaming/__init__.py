"""Structured Streaming forms of the task and transfer operators."""
