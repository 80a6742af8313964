"""Log analytics and training-data preparation as PySpark DataFrame jobs."""
