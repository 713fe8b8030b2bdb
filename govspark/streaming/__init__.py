"""The per-prompt and per-record chains as Structured Streaming jobs."""
