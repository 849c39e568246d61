"""sparkdex.functions."""
