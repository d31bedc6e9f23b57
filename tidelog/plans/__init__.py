"""plans of tidelog."""
