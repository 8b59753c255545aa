"""Rating-history analytics on Spark: catalogue, verdicts, anomaly checks, search, reports."""
