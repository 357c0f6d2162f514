"""Streaming of the change-history engine."""
