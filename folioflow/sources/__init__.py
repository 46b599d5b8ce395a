"""Where notes come from, and where steps leave them."""
