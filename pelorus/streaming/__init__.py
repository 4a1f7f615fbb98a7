"""The same logic on streams."""
