"""Plans that answer requests."""
