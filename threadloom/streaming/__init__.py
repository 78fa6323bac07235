"""Streaming triggers of the batch transforms."""
