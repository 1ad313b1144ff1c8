"""Point-in-time company-health analytics expressed as Spark DataFrame jobs."""
