"""Plans of the wearline package."""
