"""Sources of the change-history engine."""
