"""twotier.operators."""
