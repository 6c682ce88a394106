"""Readers, writers, table contracts and the standardization of raw market tables."""
