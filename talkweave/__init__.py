"""Chat-archive analytics on Spark: declarative plans over message, contact and session tables."""
