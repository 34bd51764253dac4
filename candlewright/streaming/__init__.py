"""Structured Streaming versions of the order-tolerant operators."""
