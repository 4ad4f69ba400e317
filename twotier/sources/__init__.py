"""twotier.sources."""
