"""Node tables, graphs, and the operators that make one from the other."""
