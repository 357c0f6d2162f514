"""Operators for training data from change history; nothing else in the library imports them."""
