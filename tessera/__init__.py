"""Retail customer, campaign and ticket analytics expressed as Spark DataFrame jobs."""
