"""operators of skeinlake."""
