"""Sources of the rollbook engine."""
