"""Structured Streaming deployments of the batch operators."""
