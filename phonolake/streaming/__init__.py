"""Rules on streams."""
