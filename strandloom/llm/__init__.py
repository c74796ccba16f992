"""Operators on texts and for training mixes. Nothing else in the library imports this package."""
