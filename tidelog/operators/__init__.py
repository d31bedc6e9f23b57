"""operators of tidelog."""
