"""functions of skeinlake."""
