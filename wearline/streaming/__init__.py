"""Streaming of the wearline package."""
