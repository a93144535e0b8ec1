"""Blog-monitoring analytics on Spark."""
