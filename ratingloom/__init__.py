"""League ratings, forecasts and versioned snapshots as Spark DataFrame operations."""
