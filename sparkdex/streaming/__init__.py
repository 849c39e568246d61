"""sparkdex.streaming."""
