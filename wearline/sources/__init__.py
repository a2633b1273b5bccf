"""Sources of the wearline package."""
