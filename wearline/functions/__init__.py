"""Functions of the wearline package."""
