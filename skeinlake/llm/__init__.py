"""llm of skeinlake."""
