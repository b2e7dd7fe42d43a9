"""Dataflow operators on change records."""
