"""Sources of nodes."""
