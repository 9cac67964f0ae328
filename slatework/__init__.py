"""slatework: blend partial, disagreeing sources of per-entity statistics with Spark."""
