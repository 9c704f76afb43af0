"""A market-analytics engine on Spark."""
