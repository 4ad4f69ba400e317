"""twotier.streaming."""
