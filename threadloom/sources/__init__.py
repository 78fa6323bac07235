"""Readers of on-disk transcripts."""
