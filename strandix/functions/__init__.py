"""Part of strandix."""
