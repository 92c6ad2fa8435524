"""The live tracker on Structured Streaming."""
