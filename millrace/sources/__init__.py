"""Readers of documents and of stored collections."""
