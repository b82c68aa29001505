"""Live sets on Structured Streaming."""
