"""Operators of the change-history engine."""
