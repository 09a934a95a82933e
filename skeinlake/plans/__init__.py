"""plans of skeinlake."""
