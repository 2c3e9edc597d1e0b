"""Race-meeting analytics on Spark: fixed-width ingestion, keyed upserts,
quality checks and leak-free features, all as DataFrame plans."""
