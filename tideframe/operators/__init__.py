"""DataFrame operators of the panel engine. Thresholds are parameters."""
