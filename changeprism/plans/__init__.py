"""Plans of the change-history engine."""
