"""Traces as batches and streams."""
