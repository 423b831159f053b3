"""Composed plans: whole reference workflows as one lazy frame each, plus their sinks."""
