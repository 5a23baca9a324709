"""Structured Streaming jobs and the batch jobs that define their results."""
