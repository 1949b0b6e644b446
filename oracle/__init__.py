"""SQL twins of the queries, for comparison on the driver tables."""
