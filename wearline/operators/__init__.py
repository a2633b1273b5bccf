"""Operators of the wearline package."""
