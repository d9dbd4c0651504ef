"""Structured Streaming jobs over decision ledgers and document intake."""
