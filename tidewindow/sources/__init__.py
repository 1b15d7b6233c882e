"""Cold tier, block codec and vector files."""
