"""Matching reads as they arrive."""
