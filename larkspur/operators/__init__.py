"""Generic operators over (key, time, value) tables."""
