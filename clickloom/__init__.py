"""Web and ad-campaign analytics on Spark."""
