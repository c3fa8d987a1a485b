"""Following the chain head with Structured Streaming."""
