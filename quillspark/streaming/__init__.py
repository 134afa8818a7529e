"""Continuous forms of the batch readers."""
