"""Composite questions, each one lazy plan."""
