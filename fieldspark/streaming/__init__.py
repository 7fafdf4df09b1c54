"""Fields evaluated over streams."""
