"""Plans: decide everything first, then write, then prove."""
