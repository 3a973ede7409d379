"""The same features over unbounded input."""
