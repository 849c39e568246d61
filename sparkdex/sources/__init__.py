"""sparkdex.sources."""
