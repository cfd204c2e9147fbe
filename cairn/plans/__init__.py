"""Driver queries and their SQL twins."""
