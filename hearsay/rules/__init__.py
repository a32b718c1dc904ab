"""Rule texts: their grammar, and the values that come with the package."""
