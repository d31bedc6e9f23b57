"""sources of tidelog."""
