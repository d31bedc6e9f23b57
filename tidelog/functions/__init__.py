"""functions of tidelog."""
