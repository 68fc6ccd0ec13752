"""Streaming of the rollbook engine."""
