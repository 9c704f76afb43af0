"""Stream operators."""
