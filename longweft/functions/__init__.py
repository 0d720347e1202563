"""Column functions over sequences and orientations."""
