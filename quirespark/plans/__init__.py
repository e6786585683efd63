"""Query algebra, parser and matching."""
