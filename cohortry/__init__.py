"""Cohort analytics on Spark: DataFrame-to-DataFrame operators for event data."""
