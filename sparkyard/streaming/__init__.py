"""Structured Streaming extensions of our own; the batch plans don't need them."""
