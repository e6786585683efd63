"""Change-driven updates."""
