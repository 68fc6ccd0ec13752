"""Plans of the rollbook engine."""
