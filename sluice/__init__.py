"""Message-driven dataflow semantics as Spark DataFrame and Structured Streaming queries."""
