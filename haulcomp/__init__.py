"""Survey composition engine: population at length and at age from trawl samples, on Spark."""
