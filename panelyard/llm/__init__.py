"""Training-data operators on document tables."""
