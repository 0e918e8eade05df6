"""Structured Streaming counterparts of resumable batch steps."""
