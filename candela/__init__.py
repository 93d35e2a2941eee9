"""Market-bar analytics on Spark."""
