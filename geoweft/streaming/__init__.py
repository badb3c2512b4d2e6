"""Graphs from streams of events."""
