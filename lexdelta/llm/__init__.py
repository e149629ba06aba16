"""Operators on text for preparing training data."""
