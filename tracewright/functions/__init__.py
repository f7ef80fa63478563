"""Column functions without state."""
