"""Column functions: every one is a built-in Spark expression tree, no Python in the hot path."""
