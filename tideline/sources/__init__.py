"""Sources of change records."""
