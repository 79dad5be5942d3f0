"""Wearable-health time series on Spark: ingest, upsert, clean, smooth, publish."""
