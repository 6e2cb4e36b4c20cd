"""tracefold: analytics over agent execution traces, written for Spark's DataFrame and SQL engine."""
