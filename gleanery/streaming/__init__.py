"""The stateless operators and de-duplication over Structured Streaming."""
