"""grainmill: similarity deduplication and corpus preparation on Spark."""
