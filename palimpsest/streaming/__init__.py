"""State rules over time, as batch operators and as Structured Streaming jobs."""
