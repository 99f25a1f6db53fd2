"""Hidden-text analytics on Spark."""
