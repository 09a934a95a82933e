"""sources of skeinlake."""
