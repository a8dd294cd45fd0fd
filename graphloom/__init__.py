"""Top-k graph pattern matching and graph queries on Spark."""
