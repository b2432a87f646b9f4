"""Column functions: time, geography and fixed classifications."""
