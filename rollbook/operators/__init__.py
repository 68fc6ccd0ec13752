"""Operators of the rollbook engine."""
