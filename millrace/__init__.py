"""Document data quality, invoice analytics and training-data preparation as Spark DataFrame jobs."""
