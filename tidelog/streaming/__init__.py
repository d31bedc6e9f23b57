"""streaming of tidelog."""
