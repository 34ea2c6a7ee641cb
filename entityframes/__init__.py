"""Table semantics for declared entities, as DataFrame, SQL and Structured Streaming jobs."""
