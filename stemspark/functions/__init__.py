"""Part of stemspark."""
