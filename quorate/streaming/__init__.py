"""Structured Streaming versions of ledger and event operators."""
