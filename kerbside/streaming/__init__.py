"""The engine's live side: Structured Streaming over observations."""
