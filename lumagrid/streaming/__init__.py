"""Images as they arrive."""
