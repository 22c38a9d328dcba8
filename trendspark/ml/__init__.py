"""ml package."""
