"""Functions of the rollbook engine."""
