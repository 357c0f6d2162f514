"""Functions of the change-history engine."""
