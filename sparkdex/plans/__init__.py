"""sparkdex.plans."""
