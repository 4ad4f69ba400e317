"""twotier.functions."""
