"""Model updates over Structured Streaming micro-batches."""
