"""Near-duplicate retrieval and record linkage on Spark."""
