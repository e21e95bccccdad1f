"""Jobs that chain the operators over the given tables."""
