"""Column builders: text, geography, statistics and time."""
