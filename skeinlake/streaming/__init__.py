"""streaming of skeinlake."""
