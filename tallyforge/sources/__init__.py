"""Reading, normalising and maintaining tables."""
