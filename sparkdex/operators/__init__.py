"""sparkdex.operators."""
