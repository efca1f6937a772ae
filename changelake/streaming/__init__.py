"""The mirrored table and the Structured Streaming job that feeds it."""
