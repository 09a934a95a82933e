"""Markup parsing shared by the DOM operators."""
from skeinlake.html.tree import Node, parse_html  # noqa: F401
